"""Tables stored by tag and day, so that the as-of and interval joins over them share one shuffle: that of writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.functions.scalar import micros, tag_key
from vigia.operators.asof import Layout, own_bucket


def write_tag_days(df: DataFrame, table: str, time: str, tag: str = "Tag", path: str | None = None, partitions: int | None = None) -> Layout:
    """Write ``df`` as a table in buckets by the key of its tag and the day of ``time``, and tell how to join it.

    A tag may hold a third of all rows; its days are dealt to all buckets. Rows without a time, which meet nothing, are dealt by
    their hash. Each task writes whole buckets, sorted by tag and time, so a bucket is one file. Two tables are joined without a
    shuffle if they have the same number of ``partitions`` (by default that of shuffles). An empty table keeps its schema. Columns
    that already have the names of the layout are refused.
    """
    spark = df.sparkSession
    layout = Layout(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    clash = {layout.tag, layout.bucket} & set(df.columns)
    if clash:
        raise ValueError(f"columns with names of the layout: {sorted(clash)}")
    rows = df.select(F.struct(*df.columns).alias("_row"), tag_key(tag).alias(layout.tag), micros(df, time).alias("_us"))
    rows = rows.select("_row.*", layout.tag, own_bucket("_us").alias(layout.bucket))
    writer = rows.repartition(layout.partitions, layout.tag, layout.bucket).write.mode("overwrite").bucketBy(layout.partitions, layout.tag, layout.bucket).sortBy(layout.tag, layout.bucket, time)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return layout


def read_tag_days(spark: SparkSession, table: str) -> DataFrame:
    """The stored table; its buckets are known to Spark, so use it and not its files."""
    return spark.table(table)
