"""Drift profiles from mergeable parts: what each period adds is stored once, and a profile is made of any choice of periods.

A part has, for each period and feature, a count, the counts of its values where these are few, and a quantile sketch;
for each period the alerts, and the categories of each segment. Merging adds counts, unites categories and merges sketches, so
months merge to the year's profile without a reference row being read again. Counts, alert rates and categories are
exact; bins of features with many values have edges and shares from the sketch, whose rank error is about ``RANK_ERROR``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigia.functions.scalar import number_or_null
from vigia.operators.drift import BINS, DERIVED, EPSILON, MAX_DISCRETE, discrete_edges, quantile_edges

#: Values that a sketch keeps at a level, and its rank error at that size (two-sided, at 99 %).
SKETCH_K, RANK_ERROR = 2_048, 0.002
#: Ranks at which a sketch is read; shares are multiples of one of so many.
GRID = 2_000
PERIOD = "periodo"


def feature_parts(df: DataFrame, features: list[str], period: str = PERIOD) -> DataFrame:
    """``periodo, feature, n, counts, sketch``: ``counts`` maps values to rows if there are at most 25 of them, else it is null.

    A period and feature without values has no part. Values are counted only where an estimate says that they may be few.
    """
    named = [f for f in features if f not in DERIVED]
    long = df.select(F.col(period).cast("string").alias(PERIOD), *[number_or_null(c).alias(c) for c in named]).unpivot([PERIOD], named, "feature", "value").where("value is not null")
    whole = long.groupBy(PERIOD, "feature").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"), F.approx_count_distinct("value", 0.05).alias("about"))
    values = long.join(whole.where(F.col("about") <= 2 * MAX_DISCRETE).select(PERIOD, "feature"), [PERIOD, "feature"], "left_semi").groupBy(PERIOD, "feature", "value").agg(F.count(F.lit(1)).alias("c"))
    return whole.join(value_maps(values, [PERIOD, "feature"]), [PERIOD, "feature"], "left").select(PERIOD, "feature", "n", "counts", "sketch")


def value_maps(values: DataFrame, by: list[str]) -> DataFrame:
    """``by, counts``: a map of each group's values to their counts, for groups of at most 25 values."""
    few = values.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct")).where(F.col("distinct") <= MAX_DISCRETE)
    listed = values.join(few, by, "left_semi").groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "c")))).alias("counts"))
    return listed


def alert_parts(df: DataFrame, period: str = PERIOD) -> DataFrame:
    """``periodo, linhas, alertas``; rows without a prediction count for nothing."""
    return df.where("prediction is not null").groupBy(F.col(period).cast("string").alias(PERIOD)).agg(F.count(F.lit(1)).alias("linhas"), F.sum(F.col("prediction").cast("long")).alias("alertas"))


def category_parts(df: DataFrame, segments: list[str], period: str = PERIOD) -> DataFrame:
    """``periodo, segmento, categoria, n``; null is no category."""
    rows = df.select(F.col(period).cast("string").alias(PERIOD), *[F.col(c).cast("string").alias(c) for c in segments])
    if not segments:
        return rows.select(PERIOD, F.lit("").alias("segmento"), F.lit("").alias("categoria"), F.lit(0).cast("long").alias("n")).limit(0)
    return rows.unpivot([PERIOD], segments, "segmento", "categoria").where("categoria is not null").groupBy(PERIOD, "segmento", "categoria").agg(F.count(F.lit(1)).alias("n"))


def merge_features(parts: DataFrame, period: Column | None = None) -> DataFrame:
    """Parts of coarser periods (all in one without ``period``), in the same form: merging in steps or at once is the same for counts.

    A feature keeps value counts only where all its parts have them and there are at most 25 values together.
    """
    period = (F.lit("total") if period is None else period).alias(PERIOD)
    keyed = parts.select(period, "feature", "n", "counts", "sketch")
    by = [PERIOD, "feature"]
    whole = keyed.groupBy(*by).agg(F.sum("n").alias("n"), F.bool_and(F.col("counts").isNotNull()).alias("known"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    values = keyed.select(*by, F.explode("counts").alias("value", "c")).groupBy(*by, "value").agg(F.sum("c").alias("c"))
    joined = whole.join(value_maps(values, by), by, "left")
    return joined.select(*by, "n", F.when(F.col("known"), F.col("counts")).alias("counts"), "sketch")


def profile_of(parts: DataFrame, bins: int = BINS) -> DataFrame:
    """``feature, edges, proportions`` of all parts, in the form of ``drift.reference_profile``.

    Features of at most 25 values have exact bins; others have the sketch's quantiles as edges and its shares below them.
    """
    merged = merge_features(parts).select("feature", "n", "counts", "sketch")
    values = F.sort_array(F.map_keys("counts"))
    few = merged.where("counts is not null").select("feature", "n", "counts", discrete_edges(values).alias("edges"), values.alias("v"))
    # A bin for each value; a constant's only bin holds all rows.
    few = few.select("feature", "edges", F.transform("v", lambda x: F.greatest(F.element_at("counts", x) / F.col("n"), F.lit(EPSILON))).alias("proportions"))
    ranks = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    many = merged.where("counts is null").select("feature", "sketch", F.array_distinct(F.kll_sketch_get_quantile_double("sketch", ranks)).alias("v"))
    many = many.select("feature", "sketch", quantile_edges(F.col("v")).alias("edges"))
    # The share below an edge, from the values at evenly spread ranks.
    spread = F.array(*[F.lit((k + 0.5) / GRID) for k in range(GRID)])
    many = many.select("edges", "feature", F.kll_sketch_get_quantile_double("sketch", spread).alias("grid"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    below = F.transform(inner, lambda e: F.size(F.filter("grid", lambda x: x < e)) / F.lit(float(GRID)))
    below = many.select("feature", "edges", F.concat(F.array(F.lit(0.0)), below, F.array(F.lit(1.0))).alias("r"))
    shares = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.greatest(F.get("r", i) - F.get("r", i - 1), F.lit(EPSILON)))
    return few.unionByName(below.select("feature", "edges", shares.alias("proportions")))


def alert_rate(parts: DataFrame) -> float | None:
    """The share of alerts over all periods; null without rows."""
    row = parts.agg(F.sum("alertas").alias("a"), F.sum("linhas").alias("n")).first()
    return row["a"] / row["n"] if row["n"] else None


def categories_of(parts: DataFrame) -> DataFrame:
    """``segmento, categoria`` that any period has."""
    return parts.select("segmento", "categoria").distinct()


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
