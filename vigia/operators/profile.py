"""Exploratory profiles: rates by category, densified series, histograms, box plots, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.functions.scalar import safe_percent, tag_key
from vigia.operators.ordered import ordered_counts, quantiles

TARGET = "target_4h"
# Families of features, by their names.
FAMILIES = ["Calendário e sazonalidade", "Histórico de ciclos", "Histórico de alertas", "Mudança entre janelas", "Recência e criticidade", "Codificações históricas", "Demais sinais derivados"]
CALENDAR = ["hora_do_dia", "hora", "dia_da_semana", "dia_semana", "mes", "is_fim_de_semana"]
RECENCY = ["dias_desde_ultimo_alerta", "nivel_maximo_evento_recente", "n_precondicoes_satisfeitas_4h"]


def summary(labeled: DataFrame) -> DataFrame:
    """Counts, distinct keys, positive rate, period and duration statistics in one row."""
    d = F.col("duracao_ciclo_min")
    # Distinct values are counted one column at a time, on partial aggregates, instead of copying the rows for each.
    kinds = labeled.select(*[F.col(c).cast("string") for c in ("Tag", "Frota", "Classe")]).unpivot([], ["Tag", "Frota", "Classe"], "column", "value").distinct()
    kinds = kinds.agg(*[F.count_if((F.col("column") == c) & F.col("value").isNotNull()).alias(name) for c, name in (("Tag", "tags"), ("Frota", "frotas"), ("Classe", "classes"))])
    rest = labeled.agg(F.count(F.lit(1)).alias("ciclos"), F.sum(TARGET).alias("positivos"), F.avg(TARGET).alias("taxa_positiva"), F.min("Fim").alias("inicio"), F.max("Fim").alias("fim"), F.avg(d).alias("duracao_media"))
    q = quantiles(labeled, "duracao_ciclo_min", [0.5, 0.95]).select(F.get("q", F.lit(0)).alias("duracao_mediana"), F.get("q", F.lit(1)).alias("duracao_p95"))
    out = rest.join(F.broadcast(kinds)).join(F.broadcast(q), how="left")
    return out.select("ciclos", "tags", "frotas", "classes", "positivos", "taxa_positiva", "inicio", "fim", "duracao_media", "duracao_mediana", "duracao_p95")


def rate_by_category(df: DataFrame, column: str, top: int = 15, min_rows: int = 20) -> DataFrame:
    """Target rate of each value with enough rows, the highest first; null is ``MISSING``."""
    found = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("MISSING")).alias("categoria")).agg(F.count(F.lit(1)).alias("linhas"), F.avg(F.col(TARGET).cast("double")).alias("taxa"))
    return found.where(F.col("linhas") >= min_rows).orderBy(F.desc("taxa"), "categoria").limit(top)


def risk_by_category(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """Cycles, positives and rate of each value, most positives first."""
    found = df.groupBy(F.col(column).alias("categoria")).agg(F.count(F.lit(1)).alias("ciclos"), F.sum(TARGET).alias("positivos"), F.avg(F.col(TARGET).cast("double")).alias("taxa"))
    return found.orderBy(F.desc("positivos"), "categoria").limit(top)


def value_counts(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("valor")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "valor").limit(top)


def hourly_counts(df: DataFrame, time: str = "Fim") -> DataFrame:
    """Rows of each of the 24 hours, 0 where there are none."""
    counted = df.groupBy(F.hour(time).alias("hora")).agg(F.count(F.lit(1)).alias("ciclos"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hora"))
    return hours.join(F.broadcast(counted), "hora", "left").select("hora", F.coalesce("ciclos", F.lit(0)).alias("ciclos"))


def daily_series(df: DataFrame, time: str = "Fim") -> DataFrame:
    return df.groupBy(F.to_date(time).alias("dia")).agg(F.count(F.lit(1)).alias("ciclos"), F.avg(F.col(TARGET).cast("double")).alias("taxa"))


def moving_average(series: DataFrame, rows: int = 7) -> DataFrame:
    """Mean rate of a day and the days before it, as many as there are up to the given number. One row a day."""
    return series.withColumn("media_movel", F.avg("taxa").over(W.orderBy("dia").rowsBetween(1 - rows, 0)))


def weekday_hour_matrix(df: DataFrame, time: str = "Fim") -> DataFrame:
    """Mean target by weekday (Monday is 0) and hour, as 7 rows of 24 columns; 0 where there are no rows."""
    found = df.groupBy(F.weekday(time).alias("dia_da_semana")).pivot("hora", list(range(24))).agg(F.avg(F.col(TARGET).cast("double"))) if "hora" in df.columns else weekday_hour_matrix(df.withColumn("hora", F.hour(time)), time)
    if "h0" in found.columns:
        return found
    days = df.sparkSession.range(7).select(F.col("id").cast("int").alias("dia_da_semana"))
    return days.join(F.broadcast(found), "dia_da_semana", "left").na.fill(0.0).select("dia_da_semana", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def histogram(df: DataFrame, column: str, bins: int = 60, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, inicio, n`` over bins of equal width from the smallest to the largest value, or given bounds, to which values are clipped."""
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(v.alias("v"))
    if low is None or high is None:
        low, high = rows.agg(F.min("v"), F.max("v")).first()
        if low is None:
            return df.sparkSession.createDataFrame([], "bin int, inicio double, n long")
    width = (high - low) / bins or 1.0
    clipped = F.greatest(F.least("v", F.lit(float(high))), F.lit(float(low)))
    counted = rows.groupBy(F.least(F.floor((clipped - F.lit(float(low))) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", (F.lit(float(low)) + F.col("bin") * width).alias("inicio"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, column: str = "duracao_ciclo_min", by: str = "Classe", top: int = 8) -> DataFrame:
    """Quartiles and whiskers (1.5 times the quartile range, cut to values there are) of the most frequent values."""
    frequent = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(top)
    rows = df.join(F.broadcast(frequent.select(by)), by)
    q = quantiles(rows, column, [0.25, 0.5, 0.75], [by])
    marks = q.select(by, *[F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(3)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(F.broadcast(marks), by).where((F.col(column) >= F.col("q1") - reach) & (F.col(column) <= F.col("q3") + reach))
    return inside.groupBy(by, "q1", "q2", "q3").agg(F.min(column).alias("bigode_min"), F.max(column).alias("bigode_max"))


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond 1.5 quartile ranges of the quartiles."""
    q = quantiles(df, column, [0.25, 0.75]).select(F.get("q", F.lit(0)).alias("_a"), F.get("q", F.lit(1)).alias("_b"))
    reach = 1.5 * (F.col("_b") - F.col("_a"))
    return df.join(F.broadcast(q)).where((F.col(column) < F.col("_a") - reach) | (F.col(column) > F.col("_b") + reach)).drop("_a", "_b")


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, corr`` of each pair over the rows that have both values, in one pass."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(each).alias("x")).select("x.*")


def top_correlated(df: DataFrame, columns: list[str], target: str = TARGET, top: int = 20) -> DataFrame:
    """Columns by the absolute correlation with a target."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "corr").orderBy(F.desc_nulls_last(F.abs("corr")), "feature").limit(top)


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """``value, rank`` of the distinct values, ties sharing the mean of their places."""
    counts = ordered_counts(df.select(F.col(column).cast("double").alias("value")), ["value"])
    return counts.select("value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, corr`` of average ranks of each pair, over the rows that have both values."""
    out = None
    for a, b in combinations(columns, 2):
        both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        ranks = both.join(average_ranks(both, "x").withColumnRenamed("value", "x").withColumnRenamed("rank", "rx"), "x")
        ranks = ranks.join(average_ranks(both, "y").withColumnRenamed("value", "y").withColumnRenamed("rank", "ry"), "y")
        one = ranks.agg(F.corr("rx", "ry").alias("corr")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "corr")
        out = one if out is None else out.unionByName(one)
    return out


def pareto(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Counts of the most frequent values with their share of all rows and the cumulative share."""
    counted = df.groupBy(F.col(column).cast("string").alias("categoria")).agg(F.count(F.lit(1)).alias("n"))
    share = counted.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("all")))).select("categoria", "n", safe_percent(F.col("n"), F.col("all")).alias("pct"))
    first = share.orderBy(F.desc("n"), "categoria").limit(top)
    return first.withColumn("pct_acumulado", F.sum("pct").over(W.orderBy(F.desc("n"), "categoria").rowsBetween(W.unboundedPreceding, 0)))


def feature_family(name: Column) -> Column:
    starts = lambda *p: [name.startswith(x) for x in p]
    any_ = lambda cs: cs[0] if len(cs) == 1 else cs[0] | any_(cs[1:])
    return (
        F.when(name.isin(CALENDAR), FAMILIES[0])
        .when(any_(starts("n_ciclos_", "duracao_media", "duracao_std")), FAMILIES[1])
        .when(any_(starts("n_alertas_", "alertas_por_hora")), FAMILIES[2])
        .when(any_(starts("delta_", "ratio_")), FAMILIES[3])
        .when(name.isin(RECENCY), FAMILIES[4])
        .when(any_([name.endswith("_freq"), name.endswith("_target_enc"), *starts("Frota_", "Tipo_")]), FAMILIES[5])
        .otherwise(FAMILIES[6])
    )


def family_importance(importance: DataFrame, names: int = 3) -> DataFrame:
    """Importance of each family and its most important features. ``importance``: ``feature, importance``."""
    placed = importance.withColumn("familia", feature_family(F.col("feature")))
    order = F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature")))
    return placed.groupBy("familia").agg(F.sum("importance").alias("importancia"), F.array_join(F.transform(F.slice(order, 1, names), lambda x: x["feature"]), ",").alias("principais"))


def alert_profile(telemetry: DataFrame) -> DataFrame:
    """Flagged events by type and criticality: events, tags, first and last time."""
    flagged = telemetry.where(F.col("Is_Dont_Go") == 1)
    return flagged.groupBy("Tipo", "Criticidade").agg(F.count(F.lit(1)).alias("eventos"), F.countDistinct("TAG").alias("tags"), F.min("Data_Evento").alias("primeiro"), F.max("Data_Evento").alias("ultimo"))


def rule_profile(rules: DataFrame) -> DataFrame:
    """``TIPO, NIVEL, regras``: rules of the catalogue by type and level, as they are written."""
    return rules.groupBy("TIPO", "NIVEL").agg(F.count(F.lit(1)).alias("regras"))


def alert_tags(telemetry: DataFrame, top: int = 12) -> DataFrame:
    """The tags with the most flagged events: ``tag, eventos, pct``, a share of all flagged events."""
    flagged = telemetry.where(F.col("Is_Dont_Go") == 1)
    counted = flagged.groupBy(tag_key("TAG").alias("tag")).agg(F.count(F.lit(1)).alias("eventos"))
    share = counted.join(F.broadcast(flagged.agg(F.count(F.lit(1)).alias("_all")))).select("tag", "eventos", safe_percent(F.col("eventos"), F.col("_all")).alias("pct"))
    return share.orderBy(F.desc("eventos"), "tag").limit(top)


def alert_period(telemetry: DataFrame) -> DataFrame:
    """``eventos, tags, primeiro, ultimo`` of all flagged events."""
    flagged = telemetry.where(F.col("Is_Dont_Go") == 1)
    return flagged.agg(F.count(F.lit(1)).alias("eventos"), F.countDistinct(tag_key("TAG")).alias("tags"), F.min("Data_Evento").alias("primeiro"), F.max("Data_Evento").alias("ultimo"))
