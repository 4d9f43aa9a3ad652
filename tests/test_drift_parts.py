"""Drift profiles from stored parts: merging in steps, exact and sketched bins, and checks without reference rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.operators import drift, drift_parts
from vigia.plans import pipelines

NAMES = ["few", "many", "same", "empty", "mass"]


def table(spark, n=4_000):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("2025-0"), (i % 6 + 1).cast("string")).alias("mes"),
        F.when(i % 7 > 0, (i % 5).cast("double")).alias("few"),
        F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.pow((i * 7919 % 4001).cast("double"), 1.5)).alias("many"),
        F.lit(3.5).alias("same"),
        F.lit(None).cast("double").alias("empty"),
        F.when(i % 10 < 6, 0.0).otherwise((i * 31 % 997).cast("double")).alias("mass"),
        (i % 3 == 0).cast("int").alias("prediction"),
        F.when(i % 13 > 0, F.concat(F.lit("F"), i % 4)).alias("Frota"),
    )


def shown(parts):
    return {(r["periodo"], r["feature"]): (r["n"], dict(sorted(r["counts"].items())) if r["counts"] is not None else None) for r in parts.collect()}


def test_merging_in_steps_equals_merging_at_once(spark):
    parts = drift_parts.feature_parts(table(spark), NAMES, "mes").cache()
    half = drift_parts.merge_features(parts, F.when(F.col("periodo") < "2025-04", "a").otherwise("b"))
    whole = shown(drift_parts.merge_features(parts))
    assert shown(drift_parts.merge_features(half)) == whole == shown(drift_parts.feature_parts(table(spark).withColumn("t", F.lit("total")), NAMES, "t"))
    assert ("total", "empty") not in whole and whole["total", "same"] == (4_000, {3.5: 4_000}) and whole["total", "many"][1] is None


def test_profile_of_parts_equals_the_profile_of_the_rows(spark):
    rows = table(spark)
    want = {r["feature"]: r for r in drift.reference_profile(rows, NAMES).collect()}
    got = {r["feature"]: r for r in drift_parts.profile_of(drift_parts.feature_parts(rows, NAMES, "mes")).collect()}
    assert set(got) == set(want) == {"few", "many", "same", "mass"}
    for name in ("few", "same"):
        assert got[name]["edges"] == want[name]["edges"] and got[name]["proportions"] == pytest.approx(want[name]["proportions"], abs=1e-12)
    data = rows.select("many", "mass").toPandas()
    for name in ("many", "mass"):
        values = np.sort(data[name].dropna().to_numpy())
        edges, shares = got[name]["edges"], got[name]["proportions"]
        assert edges[0] == -math.inf and edges[-1] == math.inf and len(shares) == len(edges) - 1 and sum(shares) == pytest.approx(1)
        exact = np.diff([np.searchsorted(values, e, "left") / len(values) for e in edges[:-1]] + [1.0])
        assert np.abs(np.array(shares) - exact).max() <= 2 * drift_parts.RANK_ERROR + 1 / drift_parts.GRID


def test_a_day_that_is_stored_again_replaces_itself(spark, tmp_path):
    rows, out = table(spark), str(tmp_path / "base")
    for some in (rows.where("mes < '2025-05'"), rows.where("mes >= '2025-04'")):
        pipelines.drift_baseline(some, NAMES, out, ["Frota"], "mes")
    parts = spark.read.parquet(f"{out}/features")
    assert parts.where("feature = 'few'").agg(F.sum("n")).first()[0] == rows.where("few is not null").count()
    assert drift_parts.alert_rate(spark.read.parquet(f"{out}/alerts")) == pytest.approx(1334 / 4000)
    verdict = pipelines.drift_check(rows, out, str(tmp_path / "check")).first()
    assert (verdict["retreinar"], verdict["motivos"]) == (False, "")
    bands = {r["feature"]: r["faixa"] for r in spark.read.option("header", True).csv(str(tmp_path / "check" / "drift_features")).collect()}
    assert set(bands.values()) == {"estavel"}
    other = rows.withColumns({"prediction": F.lit(1), "Frota": F.lit("F9")})
    assert pipelines.drift_check(other, out, str(tmp_path / "other")).first()["motivos"] == "volume,categorias"


def test_a_check_reads_no_reference_row(spark, tmp_path):
    rows, out = table(spark), str(tmp_path / "base")
    rows.write.parquet(str(tmp_path / "rows"))
    pipelines.drift_baseline(spark.read.parquet(str(tmp_path / "rows")), NAMES, out, ["Frota"], "mes")
    (tmp_path / "rows").rename(tmp_path / "gone")
    assert not pipelines.drift_check(spark.read.parquet(str(tmp_path / "gone")), out, str(tmp_path / "check")).first()["retreinar"]


def test_empty_tables_have_no_parts(spark):
    rows = table(spark).limit(0)
    assert drift_parts.feature_parts(rows, NAMES, "mes").count() == drift_parts.profile_of(drift_parts.feature_parts(rows, NAMES, "mes")).count() == 0
    assert drift_parts.alert_rate(drift_parts.alert_parts(rows, "mes")) is None and drift_parts.category_parts(rows, ["Frota"], "mes").count() == 0
