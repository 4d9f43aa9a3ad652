"""Order statistics and what is built on them against brute force."""

from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import rows_of
from tests.test_operators import cycles_frame, frame, ts
from vigia.operators import encoding, metrics, ordered, profile, scorecard, serving, splits
from vigia.plans.queries import ORACLES, QUERIES


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501).round(2), "b": rng.integers(0, 4, 200).astype(float), "c": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), (None, 3.0)]
    places = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in ordered.quantiles(frame(spark, rows, "g string, v double"), "v", places, ["g"]).collect()}
    assert got.keys() == values.keys()
    for g, vs in values.items():
        assert np.allclose(got[g], np.quantile(vs, places))
    assert ordered.quantiles(spark.range(0).select(F.col("id").cast("double").alias("v")), "v", places).first()["q"] == []


def test_ordered_counts(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 13).alias("v"))
    got = {r["v"]: (r["n"], r["upto"], r["total"]) for r in ordered.ordered_counts(rows, ["v"]).collect()}
    values = np.sort([k * 7919 % 13 for k in range(1000)])
    assert got == {v: (int((values == v).sum()), int((values <= v).sum()), 1000) for v in range(13)}
    assert ordered.rows_at_places(ordered.ordered_counts(rows, ["v"]), ["v"], [0, 999, 500]) == [(values[0],), (values[999],), (values[500],)]


def test_scratch_needs_a_shared_folder_on_clusters():
    class Conf:
        get = staticmethod(lambda _: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: Conf)

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        ordered.scratch_root(Session())


def cooldown(rows, hours):
    last, kept = {}, set()
    for i, tag, time in sorted(rows, key=lambda r: (r[2], r[0])):
        if tag not in last or time - last[tag] >= timedelta(hours=hours):
            last[tag] = time
            kept.add(i)
    return kept


def test_cooldown_over_days_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for tag, mean in (("A", 1.0), ("B", 3.9), ("C", 9.0), ("D", 30.0)):  # one tag never pauses for days
        at = np.cumsum(rng.exponential(mean, 150))
        rows += [(len(rows) + k, tag, ts("2026-01-01") + timedelta(minutes=int(60 * h))) for k, h in enumerate(at)]
    scored = frame(spark, [(*r, 1) for r in rows] + [(9999, None, ts("2026-01-01"), 1)], "Id long, Tag string, Fim timestamp, prediction int")
    assert {r["Id"] for r in scorecard.cooldown_dedup(scored, 4.0).collect()} == cooldown(rows, 4.0)


def test_expanding_target_equals_brute_force(spark):
    rows = [(k, ts("2026-01-01") + timedelta(hours=5 * (k // 2)), [None, "x", "y", "x"][k % 4], int(k * 7 % 3 == 0)) for k in range(60)]
    got = {r["Id"]: r["Classe_target_enc"] for r in encoding.expanding_target(frame(spark, rows, "Id long, Fim timestamp, Classe string, target_4h int")).collect()}
    for k, (i, _, c, _) in enumerate(rows):
        own, before = [r[3] for r in rows[:k] if r[2] == c], [r[3] for r in rows[:k]]
        assert got[i] == pytest.approx(np.mean(own) if own else np.mean(before) if before else 0.0)


@pytest.mark.parametrize("n", [3, 5, 23, 60])
def test_time_blocks_equal_brute_force(spark, n):
    rows = [(k * 7 % n if n % 7 else k, ts("2026-01-01") + timedelta(hours=k // 3)) for k in range(n)]
    got = {(r["Id"], r["Fim"]): r["block"] for r in encoding.time_blocks(frame(spark, rows, "Id long, Fim timestamp"), "Fim", 5).collect()}
    parts = np.array_split(np.arange(n), 5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {order[i]: b + 1 for b, part in enumerate(parts) for i in part}


def test_splits_take_times_from_elsewhere(spark):
    rows = cycles_frame(spark, 100)
    a = splits.temporal_split(rows).select("Id", "split").collect()
    b = splits.temporal_split(rows, times=rows.select("Fim")).select("Id", "split").collect()
    assert sorted(a) == sorted(b) and {r["split"] for r in a} == {"train", "val", "test", None}
    with pytest.raises(ValueError):
        splits.temporal_split(rows.limit(0))


def test_percentiles_of_profiles(spark):
    rows = cycles_frame(spark, 200).withColumn("duracao_ciclo_min", (F.col("Id") * 37 % 101).cast("double"))
    d = np.array([k * 37 % 101 for k in range(200)], float)
    got = profile.summary(rows).first()
    assert (got["tags"], got["frotas"], got["classes"], got["ciclos"]) == (5, 2, 2, 200)
    assert (got["duracao_mediana"], got["duracao_p95"]) == pytest.approx(tuple(np.quantile(d, [0.5, 0.95])))
    assert tuple(serving.duration_quantiles(rows).first()) == pytest.approx(tuple(np.quantile(d, [0.5, 0.95])))
    assert profile.summary(rows.limit(0)).first()["ciclos"] == 0
    q1, q3 = np.quantile(d, [0.25, 0.75])
    far = rows.withColumn("duracao_ciclo_min", F.when(F.col("Id") == 3, 1000.0).otherwise(F.col("duracao_ciclo_min")))
    assert [r["Id"] for r in profile.outliers(far, "duracao_ciclo_min").collect()] == [3] and q3 - q1 < 100


def test_threshold_curve_of_one_score(spark):
    scored = frame(spark, [(0.5, 0), (0.5, 1), (0.5, 0), (0.5, 1), (None, 1)], "score double, target_4h int")
    best = metrics.calibrated_threshold(scored, 0.99).first()
    assert best["target_met"] and best["alert_rate"] == 1.0 and best["degenerate"]


def test_quantiles_between_ties_are_the_tied_value(spark):
    # Ten rows at each of 97 values: nearly all neighbours are ties, and thirds and the like aren't exact in binary.
    values = [k / 97 for k in range(97) for _ in range(10)] + [k / 97 - 2.0 for k in range(97) for _ in range(10)]
    shares = [k / 100 for k in range(101)]
    got = ordered.quantiles(frame(spark, [(v,) for v in values], "v double"), "v", shares).first()["q"]
    s = sorted(values)
    for share, q in zip(shares, got, strict=True):
        at = (len(s) - 1) * share
        lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
        assert lo <= q <= hi, (share, lo, q, hi)
    # Places that miss a whole number by rounding, as 0.07 * 100 does, stay next to its value.
    apart = [k * 7919 % 10007 / 10007 for k in range(101)]
    got = ordered.quantiles(frame(spark, [(v,) for v in apart], "v double"), "v", shares).first()["q"]
    assert np.allclose(got, sorted(apart), rtol=0, atol=1e-12)
    inf = float("inf")
    odd = ordered.quantiles(frame(spark, [(v,) for v in (-inf, -inf, -1e308, 1e308, inf, inf)], "v double"), "v", [0.1, 0.3, 0.5, 0.7, 0.9]).first()["q"]
    assert odd == [-inf, -inf, 0.0, inf, inf]


def test_threshold_curve_counts_all_ties_at_a_threshold(spark):
    # As the registered query's scores: each of them held by about ten rows.
    scores = [k * 7919 % 1009 / 1009 for k in range(10_000)]
    scored = frame(spark, [(v, int(k % 7 == 0)) for k, v in enumerate(scores)], "score double, target_4h int")
    curve = metrics.threshold_curve(scored).collect()
    s, at = np.sort(scores), [(len(scores) - 1) * (k / 100) for k in range(101)]
    ties = {s[int(np.floor(a))] for a in at if s[int(np.floor(a))] == s[int(np.ceil(a))]}
    assert len(ties) > 50 and ties <= {r["threshold"] for r in curve}
    for r in curve:
        if r["threshold"] in ties:
            hit = [k for k, v in enumerate(scores) if v >= r["threshold"]]
            assert r["predicted_positive"] == len(hit) and r["false_positive"] == sum(k % 7 > 0 for k in hit)


def test_threshold_curve_of_tied_scores_matches_sql(spark, tmp_path):
    # Ids that are 10,007 apart have one score, so each of 97 scores is held by some 20 events.
    events = spark.range(2000).select(
        (F.col("id") % 97 * 103 + F.floor(F.col("id") / 97) * 10007).alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 307)").alias("ts"),
        (F.col("id") * 31 % 17).alias("user_id"),
        F.expr("element_at(array('click', 'error', 'view', 'purchase'), cast(id % 11 % 4 + 1 as int))").alias("event_type"),
        (F.col("id") * 37 % 190).cast("double").alias("value"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want, got = con.sql(ORACLES["e19_threshold_curve"]).df(), QUERIES["e19_threshold_curve"](spark, str(tmp_path)).toPandas()
    assert len(want) > 50 and rows_of(got) == rows_of(want)
