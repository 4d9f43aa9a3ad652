"""Score counts of any range, ties at a budget's cut, permutations of features, and fingerprints of multisets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigia.operators import governance, metrics, ordered, scorecard
from vigia.plans import ml


def scored(spark, rows):
    return spark.createDataFrame(rows, "Id long, split string, score double, target_4h int, Fim timestamp_ntz")


def skewed(n, seed):
    draw = random.Random(seed)
    # Most scores are tied at 0, the others are margins far outside [0, 1] or lie close together.
    score = lambda: draw.choice([0.0, 0.0, 0.0, 0.0, draw.choice([-40.0, 7.5, 1e6]), 0.001 + draw.randrange(5) * 1e-9, None, float("nan")])
    import datetime as dt

    return [(k, draw.choice(["train", "test", None]), score(), draw.randrange(2), dt.datetime(2025, 1, 1) + dt.timedelta(hours=k)) for k in range(n)]


def test_score_counts_match_brute_force(spark):
    rows = skewed(300, 1)
    got = {(r["split"], r["score"]): (r["n"], r["pos"], r["cum_n"], r["cum_pos"], r["total_n"], r["total_pos"]) for r in metrics.score_counts(scored(spark, rows), ["split"]).collect()}
    known = [(s, x, y) for _, s, x, y, _ in rows if s and x is not None and x == x]
    want = {}
    for s, x, _ in known:
        mine = [(a, y) for t, a, y in known if t == s]
        want[s, x] = (sum(a == x for a, _ in mine), sum(y for a, y in mine if a == x), sum(a >= x for a, _ in mine), sum(y for a, y in mine if a >= x), len(mine), sum(y for _, y in mine))
    assert got == want


@pytest.mark.parametrize("seed", [2, 3])
def test_budgets_split_ties_by_id(spark, seed):
    rows = [r if r[2] is None or r[2] == r[2] else (*r[:2], None, *r[3:]) for r in skewed(400, seed)]
    got = {(r["split"], r["budget_pct"]): (r["selected_rows"], r["positives_captured"]) for r in scorecard.budget_metrics(scored(spark, rows).where("split is not null")).collect()}
    for split in ("train", "test"):
        mine = sorted((-x, i, y) for i, s, x, y, _ in rows if s == split and x is not None)
        for pct in scorecard.BUDGETS:
            n = max(-(-len(mine) * round(pct * 1000) // 1000), 1)
            assert got[split, pct] == (n, sum(y for _, _, y in mine[:n]))


def test_places_are_those_of_the_order(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 7919 % 500).alias("v"), F.lit("x").alias("extra"))
    assert {r["v"]: r["place"] for r in ordered.placed(rows, ["v"]).collect()} == {v: v + 1 for v in range(500)}
    assert ordered.placed(rows.limit(0), ["v"]).count() == 0


def test_permutations_keep_the_values(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice([None, 1.0, 2.0, float(k)]), draw.choice([True, False, None]), k % 2) for k in range(120)]
    data = spark.createDataFrame([*rows, rows[0]], "Id long, a double, b boolean, target_4h int")
    got = ml.permuted(data, ["a", "b"], 2).collect()
    assert len(got) == 121 * 4
    orders = {}
    for f in ("a", "b"):
        for r in range(2):
            mine = [x for x in got if (x["_feature"], x["_repeat"]) == (f, r)]
            for name, at in (("a", 1), ("b", 2)):
                assert Counter(x[name] for x in mine) == Counter(x[at] for x in [*rows, rows[0]])
            own = dict((x[0], x) for x in rows)
            other = "b" if f == "a" else "a"
            assert all(x[other] == own[x["Id"]][2 if other == "b" else 1] for x in mine)
            orders[f, r] = [x[f] for x in sorted(mine, key=lambda x: x["Id"])]
    assert orders["a", 0] != orders["a", 1] and orders["a", 0] != [x[1] for x in rows]


def test_importance_of_permuted_features(spark):
    data = spark.range(400).select(F.col("id").alias("Id"), (F.col("id") % 10).cast("double").alias("good"), F.when(F.col("id") % 3 > 0, F.xxhash64("id") % 7).cast("double").alias("noise"), (F.col("id") % 10 > 6).cast("int").alias("target_4h"))
    model = ml.fit(data, ["good", "noise"])
    got = {r["feature"]: r["importance"] for r in ml.importance(model, data, ["good", "noise"]).collect()}
    assert got["good"] > 0.4 and abs(got["noise"]) < 0.1
    again = {r["feature"]: r["importance"] for r in ml.importance(model, data.repartition(5), ["good", "noise"]).collect()}
    assert again == pytest.approx(got)


def test_fingerprints_count_repeated_rows(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "a string, b string")
    digest = lambda *x: governance.fingerprint(rows(*x)).first()["digest"]
    assert digest(("p", "p"), ("p", "p"), ("z", "z")) != digest(("q", "q"), ("q", "q"), ("z", "z"))
    assert digest(("p", "p"), ("z", "z")) == digest(("z", "z"), ("p", "p"))
    assert digest((None, "x")) != digest(("x", None)) and digest() == digest()
    assert governance.fingerprint(rows(("x", "y"))).first()["digest"] != governance.fingerprint(rows(("x", "y")).toDF("b", "a")).first()["digest"]
