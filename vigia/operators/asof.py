"""As-of and interval-count joins as tagged unions with growing windows.

Spark SQL has no as-of join. Rows of both sides are put together and ordered by time inside a tag. A fleet may have
few tags, and one may hold a third of all rows, so windows run inside a tag and a time bucket: what the nearest
event outside the bucket is comes in as a row of its own, and windows of a fixed length see the bucket before through
copies of its rows. Every frame starts at the bucket's edge, so it only grows from row to row: Spark updates it instead of
reading it anew, and time is linear in the rows of a tag and day. A window ``[t - w, t)`` is a difference of such sums
at its two edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.functions.scalar import DAY_US, micros

BUCKET_US = DAY_US
#: Before any time, in the order of a bucket.
FIRST = -(1 << 62)


def bucket_of(us: Column) -> Column:
    return F.floor(us / F.lit(BUCKET_US)).cast("long")


def own_bucket(us: str, row: str = "_row") -> Column:
    """The bucket of a row; rows without a time, which meet nothing, are dealt to buckets that no time has."""
    return F.when(F.col(us).isNotNull(), bucket_of(F.col(us))).otherwise(F.pmod(F.xxhash64(row), F.lit(4096)) + FIRST)


@dataclass(frozen=True)
class Layout:
    """Both sides are stored in ``partitions`` buckets by these columns: the key of the tag and the bucket of the time that is joined by.

    ``sources.layout.write_tag_days`` writes such tables. The rows of a tag and day of both sides lie in buckets of the same number
    then, so the joins shuffle no row of them but the copies for the next day and one row for each tag and day.
    """

    partitions: int
    tag: str = "tag_key"
    bucket: str = "tag_day"

    def place(self, df: DataFrame) -> DataFrame:
        """Rows from elsewhere, shuffled to where the stored ones of their tag and bucket are."""
        return df.repartition(self.partitions, "_tag", "_bucket")


def unpacked(rows: DataFrame, columns: list[str], layout: Layout | None, *added: str) -> DataFrame:
    """The rows of ``_row`` with what was added. Stored keys are those that the rows are placed by, so the next join finds them placed."""
    if not layout:
        return rows.select("_row.*", *added)
    keys = {layout.tag: "_tag", layout.bucket: "_bucket"}
    return rows.select(*[F.col(keys[c]).alias(c) if c in keys else F.col("_row").getField(c).alias(c) for c in columns], *added)


def before_row(order: str, *by: str) -> W:
    """The rows of a bucket that come strictly before a row in its order; the frame only grows."""
    return W.partitionBy("_tag", "_bucket", *by).orderBy(order).rangeBetween(W.unboundedPreceding, -1)


def nearest(left: DataFrame, right: DataFrame, time: str, right_time: str, tag: str = "Tag", right_tag: str | None = None, after: bool = True, payload: list[str] | None = None, name: str = "near", layout: Layout | None = None) -> DataFrame:
    """``left`` with ``name``: struct ``us`` and the payload of the nearest row of ``right`` strictly after (or before) its time.

    Of right rows at the same time the largest (after: smallest) payload is taken. Left rows with a null time,
    and those with no such row, get null. Right rows with a null time or tag are left out. With a ``layout`` both sides are
    stored by its columns, which take the place of ``tag`` and ``right_tag``.
    """
    right_tag = right_tag or tag
    tag, right_tag = (layout.tag, layout.tag) if layout else (tag, right_tag)
    payload = payload or []
    hit = F.struct(F.col("_us").alias("us"), *payload)
    r = placed_rows(right, right_tag, right_time, layout, *payload).where("_us is not null and _tag is not null").select("_tag", "_us", hit.alias("_hit"), "_bucket")
    keyed = placed_rows(left, tag, time, layout, F.struct(*left.columns).alias("_row"))
    # A time after is a time before in descending order.
    best, sign = (F.min, -1) if after else (F.max, 1)
    # The nearest event outside the bucket: one row for each tag and bucket of either side, which comes first in the bucket.
    per_bucket = r.groupBy("_tag", "_bucket").agg(best("_hit").alias("_best"))
    buckets = per_bucket.unionByName(keyed.where("_us is not null and _tag is not null").select("_tag", "_bucket").distinct(), allowMissingColumns=True).groupBy("_tag", "_bucket").agg(best("_best").alias("_best"))
    order = W.partitionBy("_tag").orderBy(F.col("_bucket") * sign).rowsBetween(W.unboundedPreceding, -1)
    outside = buckets.select("_tag", "_bucket", F.lit(FIRST).cast("long").alias("_order"), best("_best").over(order).alias("_hit")).where("_hit is not null")
    placed = lambda df: df.withColumn("_order", F.col("_us") * sign).drop("_us")
    outside = layout.place(outside) if layout else outside
    rows = placed(keyed).unionByName(placed(r).unionByName(outside), allowMissingColumns=True)
    found = rows.withColumn(name, best("_hit").over(before_row("_order"))).where("_row is not null")
    return unpacked(found, left.columns, layout, name)


def placed_rows(df: DataFrame, tag: str, time: str, layout: Layout | None, *columns: Column | str) -> DataFrame:
    """``_tag, _us, _bucket`` and the columns; the bucket is the stored one if there is one."""
    us = micros(df, time)
    if layout:
        return df.select(F.col(tag).alias("_tag"), us.alias("_us"), F.col(layout.bucket).alias("_bucket"), *columns)
    rows = df.select(F.col(tag).alias("_tag"), us.alias("_us"), *columns)
    return rows.withColumn("_bucket", own_bucket("_us", "_row") if "_row" in rows.columns else bucket_of(F.col("_us")))


def with_halo(df: DataFrame, us: str) -> DataFrame:
    """Each row in its time bucket, and once more, not as ``_own``, in the next one. Rows without a time have one place."""
    own = own_bucket(us, "_row") if "_row" in df.columns else bucket_of(F.col(us))
    next_one = F.when(F.col(us).isNotNull(), F.struct((bucket_of(F.col(us)) + 1).alias("b"), F.lit(False).alias("own")))
    places = F.array_compact(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), next_one))
    return df.withColumn("_at", F.explode(places)).withColumns({"_bucket": F.col("_at.b"), "_own": F.col("_at.own")}).drop("_at")


def checked_widths(widths_us: list[int]) -> None:
    if any(not 0 < w <= BUCKET_US for w in widths_us):
        raise ValueError("a window must be longer than nothing and no longer than a bucket")


def edge_values(names: dict[str, int], value: str, *by: str) -> dict[str, Column]:
    """For each named width the value at the window's end without that at its start, on the rows that are their own end.

    Rows have ``_at``, the time that an edge belongs to, and ``_edge``: the width of a start, 0 at an end. Edges of one time
    lie in one bucket, so they meet without another shuffle.
    """
    together = W.partitionBy("_tag", "_bucket", "_at", *by)
    start = lambda w: F.max(F.when(F.col("_edge") == w, F.col(value))).over(together)
    return {n: F.coalesce(F.col(value), F.lit(0)) - F.coalesce(start(w), F.lit(0)) for n, w in names.items()}


def interval_counts(left: DataFrame, right: DataFrame, time: str, right_time: str, widths_us: dict[str, int], tag: str = "Tag", right_tag: str | None = None, layout: Layout | None = None) -> DataFrame:
    """``left`` with the number of right rows in ``[t - width, t)`` for each named width, up to one bucket long.

    Left rows without a time or tag count 0; right rows without one are left out. With a ``layout`` both sides are stored by
    its columns, which take the place of ``tag`` and ``right_tag``.
    """
    checked_widths(list(widths_us.values()))
    right_tag = right_tag or tag
    tag, right_tag = (layout.tag, layout.tag) if layout else (tag, right_tag)
    # Ties of events are counted before the union: one row for each tag and instant.
    r = placed_rows(right, right_tag, right_time, layout).where("_us is not null and _tag is not null").groupBy("_tag", "_bucket", "_us").agg(F.count(F.lit(1)).alias("_n"))
    r = r.unionByName(layout.place(r.withColumn("_bucket", F.col("_bucket") + 1))) if layout else with_halo(r, "_us").drop("_own")
    keyed = placed_rows(left, tag, time, layout, F.struct(*left.columns).alias("_row")).withColumnRenamed("_us", "_at")
    edges = F.explode(F.array(*[F.lit(w).cast("long") for w in (0, *widths_us.values())])).alias("_edge")
    edges = keyed.select("_tag", "_bucket", "_at", edges, "_row").withColumns({"_us": F.col("_at") - F.col("_edge"), "_row": F.when(F.col("_edge") == 0, F.col("_row"))})
    counted = edges.unionByName(r, allowMissingColumns=True).withColumn("_sum", F.sum("_n").over(before_row("_us"))).where("_edge is not null")
    return counted.withColumns(edge_values(widths_us, "_sum")).where("_row is not null").transform(unpacked, left.columns, layout, *widths_us)
