"""Order statistics of any number of rows: values dealt to ranges of their order, with counts carried over the ranges.

No task sees more than a range. The ranges are written before they are numbered, so all that is derived from them
agrees, whatever is run again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local master may do without."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_vigia_scratch", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vigia-")
        context._vigia_scratch = root
        context.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_counts(df: DataFrame, values: list[str], by: list[str] | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """``by, values, n, upto, total``: rows at each distinct value, at it or below, and in all of its group.

    Rows without a value or a group are left out. ``values`` are compared in order. ``sums`` names sums of whole-number columns that are
    taken alike: ``{"pos": "y"}`` adds ``pos, upto_pos, total_pos``.
    """
    by, sums = by or [], sums or {}
    known = df.na.drop(subset=[*by, *values])
    counts = known.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(s) for s, c in sums.items()])
    parts = written(counts.repartitionByRange(*by, *values).withColumn("_p", F.spark_partition_id()), "ordered")
    # One row for each range and group in it.
    sizes = parts.groupBy(*by, "_p").agg(*[F.sum(c).alias(f"_c_{c}") for c in ("n", *sums)])
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    named = {"n": ("upto", "total"), **{s: (f"upto_{s}", f"total_{s}") for s in sums}}
    starts = sizes.select(*by, "_p", *[F.coalesce(F.sum(f"_c_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in named], *[F.sum(f"_c_{c}").over(whole).alias(total) for c, (_, total) in named.items()])
    inside = W.partitionBy("_p", *by).orderBy(*values).rowsBetween(W.unboundedPreceding, 0)
    ran = parts.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in named}).join(F.broadcast(starts), [*by, "_p"])
    out = [x for c, (upto, total) in named.items() for x in (F.col(c), (F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(upto), F.col(total))]
    return ran.select(*by, *values, *out)


def placed(df: DataFrame, order: list[str], label: str = "placed") -> DataFrame:
    """The rows, written, with their ``place`` from 1 in this order: sorted ranges, with the counts of the ranges before.

    The order should tell all rows apart; equal ones are placed at will.
    """
    kept = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    kept = kept.withColumns({"_p": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # One row for each range.
    earlier = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(starts), "_p").withColumn("place", F.col("_before") + F.col("_in") + 1).drop("_at", "_p", "_in", "_before")


def rows_at(counts: DataFrame, values: list[str], shares: list[float]) -> tuple[int, list[tuple]]:
    """Of ungrouped ``ordered_counts`` the number of rows, and the values of the rows at place ``int(n * share)`` from 0."""
    n = counts.agg(F.max("total")).first()[0] or 0
    return n, rows_at_places(counts, values, [min(int(n * s), n - 1) for s in shares]) if n else []


def rows_at_places(counts: DataFrame, values: list[str], places: list[int]) -> list[tuple]:
    """The values of the rows at these places from 0; one row for each place comes to the driver."""
    wanted = counts.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "_place long")
    hit = counts.join(F.broadcast(wanted), (F.col("_place") < F.col("upto")) & (F.col("_place") >= F.col("upto") - F.col("n")))
    found = {r["_place"]: tuple(r[v] for v in values) for r in hit.select("_place", *values).collect()}
    return [found[p] for p in places]


def quantiles(df: DataFrame, value: str, places: list[float], by: list[str] | None = None) -> DataFrame:
    """``by, q``: exact quantiles of each group, interpolated between the two nearest rows; empty groups have no row, no groups at all an empty list.

    A quantile is never outside the two values, and equals them where they are equal.
    """
    return quantiles_of(ordered_counts(df, [value], by), value, places, by)


def quantiles_of(counts: DataFrame, value: str, places: list[float], by: list[str] | None = None) -> DataFrame:
    by = by or []
    totals = counts.groupBy(*by).agg(F.max("total").alias("_t")).where("_t is not null")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(float(p)).alias("p")) for k, p in enumerate(places)])).alias("_w")
    wanted = totals.select(*by, "_t", each).select(*by, F.col("_w.i").alias("_i"), ((F.col("_t") - 1) * F.col("_w.p")).alias("_pos"))
    wanted = wanted.select("*", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_k")).distinct()
    at = (F.col("_k") < F.col("upto")) & (F.col("_k") >= F.col("upto") - F.col("n"))
    names = [F.col(b).alias(f"_{b}") for b in by]
    same = [F.col(b) == F.col(f"_{b}") for b in by]
    hit = counts.join(F.broadcast(wanted.select(*names, "_i", "_pos", "_k")), [*same, at] if by else at)
    v, low, high = F.col(value).cast("double"), F.floor("_pos"), F.ceil("_pos")
    ends = hit.groupBy(*by, "_i", "_pos").agg(F.max(F.when(F.col("_k") == low, v)).alias("_lo"), F.max(F.when(F.col("_k") == high, v)).alias("_hi"))
    # Between ties exactly their value: two rounded weights may add up to a bit more or less, and a comparison with the quantile
    # would miss the ties. The weights are left for values without a finite difference.
    lo, hi = F.col("_lo"), F.col("_hi")
    near, far = F.least(lo + (F.col("_pos") - low) * (hi - lo), hi), (high - F.col("_pos")) * lo + (F.col("_pos") - low) * hi
    mixed = F.when(low == high, lo).when(hi - lo < float("inf"), near).otherwise(far)
    listed = F.sort_array(F.collect_list(F.struct("_i", mixed.alias("v"))))
    return ends.groupBy(*by).agg(F.transform(listed, lambda x: x["v"]).alias("q"))
