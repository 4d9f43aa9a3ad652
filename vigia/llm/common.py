"""Helpers that the training-data operators share: tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.operators.ordered import scratch_root

#: The characters that separate words in every contract of this subpackage.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the tasks that ran on it, since what they read
    is on storage that every executor sees.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Scratch tables of this process that are still there, the oldest first.
_written: list[str] = []


def scratch_tables() -> set[str]:
    """The scratch tables that are there now."""
    return set(_written)


def clear_scratch(spark: SparkSession, keep: set[str]) -> None:
    """Delete the tables that ``materialize`` wrote, but for ``keep``; call it when the results made of them are written."""
    for path in [p for p in _written if p not in keep]:
        _written.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in names]:
        _written.remove(path)
        _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what a task builds for one batch stays small beside long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_batches(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` bytes of a string column; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
