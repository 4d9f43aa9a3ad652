"""The pipeline's stages against brute force."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_classes, check_packing, empty, odd
from vigia.llm import common
from vigia.llm.quality_rules import quality_verdicts

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if k else {}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "best-fit packing":
            assert sorted(out.columns) == sorted(columns)
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "quality rules":
            assert after == {r["key"] for r in quality_verdicts(docs).where("kept").collect()}
        elif name == "exact dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d] or ""), d)
            assert after == set(first.values())
        elif name == "n-gram Jaccard join":
            assert after == {d for d, (_, c) in brute_classes(before.items()).items() if d == c}
        elif name == "best-fit packing":
            assert after == set(before)
            used, least = check_packing(out.collect(), [r["length"] for r in out.collect()], 2048)
            assert used <= 1.02 * least + 1
        docs = out


def test_run_leaves_only_its_stages(spark):
    before = common.scratch_tables()
    other = common.materialize(spark.range(3), "other")
    rows = corpus_pipeline.run(spark, SF)
    assert common.scratch_tables() - before == {next(iter(common.scratch_tables() - before))} and other.count() == 3
    assert rows.count() > 0 and rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    common.remove(other)
    # Scratch that stages of other tests had left may be gone as well.
    assert common.scratch_tables() <= before


def test_odd_and_empty_tables(spark, tmp_path):
    docs = odd(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.where(F.col("doc_id").isNull()).count() <= 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


def test_stages_judge_rows_without_and_with_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.where("length(text) between 300 and 3000").collect()}
    left = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, SF).select("doc_id").collect()}
    toxic = next(t for d, t in sorted(texts.items()) if d not in left)
    clean = next(t for d, t in sorted(texts.items()) if d in left)
    words = [f"w{k}" for k in range(100)]
    base, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(f"v{k}" for k in range(100))
    cases = {
        "toxicity": ([(None, toxic), (None, clean), (7, toxic), (7, clean)], [(None, clean), (7, clean)]),
        "quality rules": ([(None, "too short"), (None, base), (7, "too short"), (7, base)], [(None, base), (7, base)]),
        "exact dedup": ([(None, base), (None, base), (7, base), (7, base), (7, other), (9, other), (None, near), (None, near)], [(7, base), (7, other), (None, near)]),
        "n-gram Jaccard join": ([(None, near), (7, base), (7, near), (7, other), (9, other), (3, "a b c"), (None, "a b c"), (3, "a b d")], [(7, base), (7, other), (3, "a b c"), (3, "a b d")]),
    }
    order = lambda rows: sorted(rows, key=str)
    for name, stage in corpus_pipeline.STAGES:
        if name in cases:
            given, want = cases[name]
            rows = spark.createDataFrame([(d, t, "xx") for d, t in given], "doc_id long, text string, lang string").coalesce(1)
            assert order((r["doc_id"], r["text"]) for r in stage(spark, rows, SF).collect()) == order(want), name
