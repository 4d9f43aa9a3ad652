"""A pipeline over ``documents``: toxic and poor texts go, exact and near copies go, the rest is packed.

Each stage works on all rows that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import clear_scratch, materialize, scratch_root, scratch_tables, table
from vigia.llm.exact_dedup import exact_dedup, halves
from vigia.llm.jaccard_join import jaccard_classes
from vigia.llm.packing import pack_documents
from vigia.llm.quality_rules import quality_verdicts
from vigia.llm.toxicity import fit_chain, toxicity_scores


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of stages of this process that are still there.
_left: set[str] = set()


def stage(work: Stage) -> Stage:
    """A stage that first deletes the scratch tables of the stages before it, whose results are written by then.

    Those that its own input reads stay, and so do tables that no stage wrote.
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
            gone = {p for p in _left if p.rsplit("/", 1)[-1] not in read}
            clear_scratch(spark, scratch_tables() - gone)
            _left.difference_update(gone)
        before = scratch_tables()
        out = work(spark, docs, sf_dir)
        _left.update(scratch_tables() - before)
        return out

    return run_stage


#: The number of a row in a stage's input. Ids may lack or repeat, so verdicts are joined by it.
ROW = "pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written so that it stays the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered rows other than those of ``gone``."""
    return rows.join(gone.select(ROW), ROW, "left_anti").drop(ROW)


def first_of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (``ROW, group``) the row with the smallest id stays, the first one if it repeats; no id is larger than any."""
    named = materialize(groups.join(rows.select(ROW, "doc_id"), ROW), "pipeline-groups")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return without(rows, named.join(first.select(F.col("first")[ROW].alias(ROW)), ROW, "left_anti"))


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = numbered(docs)
    return without(rows, toxicity_scores(rows, chain, key=ROW).where("toxic"))


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, whose references are the texts of the stage, go."""
    rows = numbered(docs)
    return without(rows, quality_verdicts(rows, key=ROW, of_table=True).where("not kept").select(F.col("key").alias(ROW)))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    rows = numbered(docs)
    marked = exact_dedup(*halves(rows, ROW), key=ROW)
    return first_of_groups(rows, marked.where("group_size > 1").select(F.col("key").alias(ROW), F.col("keep_id").alias("group")))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; texts without words link with nothing."""
    rows = numbered(docs)
    classes = jaccard_classes(rows, key=ROW, counts=False)
    return first_of_groups(rows, classes.select(F.col("key").alias(ROW), F.col("component_id").alias("group")))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their sequences; null texts count as empty, repeated rows each keep their pieces."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again as the next one's documents.

    Scratch tables of a stage are deleted when its result is written. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, work) in enumerate(STAGES):
        before = scratch_tables()
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        clear_scratch(spark, before)
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: The classifier and the packing can't be said in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None
