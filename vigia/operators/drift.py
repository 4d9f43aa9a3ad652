"""Drift between a reference and a batch: population stability, alert volume, categories, and the retrain rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.scalar import number_or_null
from vigia.operators.ordered import ordered_counts, quantiles_of, written

EPSILON = 1e-6
MAX_DISCRETE = 25
BINS = 10
MODERATE, SIGNIFICANT = 0.10, 0.25
# Names of the bands.
BANDS = {"stable": "estavel", "moderate": "moderado", "significant": "significativo", "unknown": "indisponivel", "absent": "ausente_no_lote"}
DERIVED = {"Classe_target_enc", "Tag_freq", "Operador_freq"}


def long_values(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, value`` of all numeric values that are there."""
    return df.select(*[number_or_null(c).alias(c) for c in features]).unpivot([], features, "feature", "value").where("value is not null")


def reference_edges(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """``feature, edges``: a bin for each of up to 25 distinct values, else quantile bins; open at both ends.

    A constant feature has one narrow bin. The values are counted once, and listed only where there are few of them.
    """
    counts = ordered_counts(long_values(df, features), ["value"], ["feature"])
    few = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))
    small = counts.join(F.broadcast(few.where(F.col("distinct") <= MAX_DISCRETE)), "feature").groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("v"))
    many = counts.join(F.broadcast(few.where(F.col("distinct") > MAX_DISCRETE)), "feature")
    large = quantiles_of(many, "value", [k / bins for k in range(bins + 1)], ["feature"]).select("feature", F.array_distinct("q").alias("v"))
    return small.select("feature", discrete_edges(F.col("v")).alias("edges")).unionByName(large.select("feature", quantile_edges(F.col("v")).alias("edges")))


def _constant(v: Column) -> Column:
    return F.array(F.get(v, F.lit(0)), F.get(v, F.lit(0)) + EPSILON)


def discrete_edges(v: Column) -> Column:
    """Edges halfway between sorted values, open at both ends; one narrow bin for a single value."""
    inf = F.lit(float("inf"))
    middle = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: (F.get(v, i - 1) + F.get(v, i)) / 2)
    return F.when(F.size(v) < 2, _constant(v)).otherwise(F.concat(F.array(-inf), middle, F.array(inf)))


def quantile_edges(v: Column) -> Column:
    """Distinct sorted quantiles as edges, the outer ones open."""
    inf = F.lit(float("inf"))
    inner = F.slice(v, 2, F.greatest(F.size(v) - 2, F.lit(0)))
    return F.when(F.size(v) < 2, _constant(v)).otherwise(F.concat(F.array(-inf), inner, F.array(inf)))


def bin_of(value: Column, edges: Column) -> Column:
    """Bin from 0, closed on the left, the last one on both sides; null outside all edges."""
    n = F.size(edges) - 1
    at = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.when(value == F.element_at(edges, -1), n - 1).when((at >= 0) & (at < n), at)


def bin_proportions(df: DataFrame, edges: DataFrame) -> DataFrame:
    """``feature, bin, p`` for every bin of each feature, no less than epsilon; all epsilon without values.

    Values are counted by bin on the map side; the edges are one row for each feature.
    """
    features = [r["feature"] for r in edges.select("feature").collect() if r["feature"] in df.columns]
    if not features:
        counted = edges.sparkSession.createDataFrame([], "feature string, bin int, c long")
    else:
        binned = long_values(df, features).join(F.broadcast(edges), "feature").select("feature", bin_of(F.col("value"), F.col("edges")).alias("bin"))
        counted = binned.where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    totals = counted.groupBy("feature").agg(F.sum("c").alias("total"))
    joined = every.join(counted, ["feature", "bin"], "left").join(totals, "feature", "left")
    return joined.select("feature", "bin", F.greatest(F.coalesce(F.col("c") / F.col("total"), F.lit(EPSILON)), F.lit(EPSILON)).alias("p"), F.coalesce("total", F.lit(0)).alias("total"))


def reference_profile(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """``feature, edges, proportions``; derived encodings are left out, features without values have no row."""
    edges = written(reference_edges(df, [f for f in features if f not in DERIVED], bins), "edges")
    parts = bin_proportions(df, edges).groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("proportions"))
    return edges.join(parts, "feature")


def psi_band(psi: Column) -> Column:
    return F.when(psi.isNull() | F.isnan(psi), BANDS["unknown"]).when(psi < MODERATE, BANDS["stable"]).when(psi < SIGNIFICANT, BANDS["moderate"]).otherwise(BANDS["significant"])


def feature_drift(batch: DataFrame, profile: DataFrame) -> DataFrame:
    """``feature, psi, faixa`` for each feature of the profile, absent ones included."""
    current = bin_proportions(batch, profile.select("feature", "edges"))
    reference = profile.select("feature", F.posexplode("proportions").alias("bin", "r"))
    ratio = (F.col("p") - F.greatest("r", F.lit(EPSILON))) * F.ln(F.col("p") / F.greatest("r", F.lit(EPSILON)))
    summed = reference.join(current, ["feature", "bin"]).groupBy("feature").agg(F.sum(ratio).alias("psi"), F.max("total").alias("total"))
    psi = F.when(F.col("total") > 0, F.col("psi"))
    present = F.col("feature").isin(batch.columns)
    return summed.select("feature", psi.alias("psi"), F.when(~present, BANDS["absent"]).otherwise(psi_band(psi)).alias("faixa"))


def categories(df: DataFrame, segments: list[str]) -> DataFrame:
    """``segmento, categoria`` of the segments that there are; null is no category."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in segments]).unpivot([], segments, "segmento", "categoria").where("categoria is not null").distinct()


def segment_drift(reference: DataFrame, batch: DataFrame, segments: list[str]) -> DataFrame:
    """``segmento, categoria, estado``: categories only in the batch (nova) or only in the reference (ausente)."""
    return category_drift(categories(reference, segments), categories(batch, segments))


def category_drift(known: DataFrame, found: DataFrame) -> DataFrame:
    """The same of two tables of categories."""
    new = found.exceptAll(known).withColumn("estado", F.lit("nova"))
    return new.unionByName(known.exceptAll(found).withColumn("estado", F.lit("ausente")))


def alert_volume(reference_rate: float, batch: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Expected and observed alert rate, their relative difference and whether it is out of tolerance."""
    observed = batch.agg(F.avg(F.col("prediction").cast("double")).alias("observado"))
    change = F.abs(F.col("observado") - reference_rate) / reference_rate if reference_rate > 0 else F.lit(float("inf"))
    return observed.select(F.lit(float(reference_rate)).alias("esperado"), "observado", change.alias("variacao_relativa"), (change > tolerance).alias("fora_da_tolerancia"))


def retrain_reasons(features: DataFrame, score_psi: DataFrame, volume: DataFrame, segments: DataFrame, max_drifted: int = 3) -> DataFrame:
    """``retreinar`` and the named reasons."""
    drifted = features.agg(F.count_if(F.col("faixa") == BANDS["significant"]).alias("n"))
    score = score_psi.agg(F.max((F.col("faixa") == BANDS["significant"]).cast("int")).alias("s"))
    out_of = volume.select(F.col("fora_da_tolerancia").alias("v"))
    new = segments.where("estado = 'nova'").agg(F.count(F.lit(1)).alias("c"))
    all_ = drifted.join(F.broadcast(score)).join(F.broadcast(out_of)).join(F.broadcast(new))
    reasons = F.array_compact(F.array(F.when(F.col("n") > max_drifted, F.lit("features")), F.when(F.col("s") == 1, F.lit("score")), F.when(F.col("v"), F.lit("volume")), F.when(F.col("c") > 0, F.lit("categorias"))))
    return all_.select((F.size(reasons) > 0).alias("retreinar"), F.array_join(reasons, ",").alias("motivos"))
