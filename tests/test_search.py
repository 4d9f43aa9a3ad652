"""Proposals that learn, and trials and folds that run side by side with the same results."""

import math
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from vigia.plans import ml, search

SPACE = {"x": (0.001, 10.0, False, True), "y": (0.0, 1.0, False, False), "n": (1, 100, True, False)}


def value(p):
    return -((math.log10(p["x"]) + 1.3) ** 2) - 4 * (p["y"] - 0.8) ** 2 - ((p["n"] - 30) / 50) ** 2


def best_of(n, seed, learns):
    seen = []
    for k in range(n):
        p = search.propose(seen if learns else [], SPACE, random.Random(f"{seed}:{k}"))
        assert 0.001 <= p["x"] <= 10 and 0 <= p["y"] <= 1 and p["n"] in range(1, 101)
        seen.append((p, value(p)))
    return max(v for _, v in seen)


def test_proposals_improve_on_random_draws():
    learned, drawn = ([best_of(40, seed, learns) for seed in range(20)] for learns in (True, False))
    assert sum(a > b for a, b in zip(learned, drawn, strict=True)) >= 15 and sum(learned) > sum(drawn) / 2
    assert best_of(12, 3, True) == best_of(12, 3, True)


def modelled(spark):
    i = F.col("id")
    rows = spark.range(600).select(i.alias("Id"), F.concat(F.lit("T"), i % 20).alias("Tag"), F.timestamp_seconds(1_750_000_000 + i * 3_600).alias("Fim"), (i % 17).cast("double").alias("a"), F.when(i % 5 > 0, (i * 31 % 13).cast("double")).alias("b"), (i % 2 == 0).alias("c"), (i % 17 > 12).cast("int").alias("target_4h"))
    return rows.withColumn("split", F.when(i < 400, "train").when(i < 500, "val").otherwise("test"))


def test_trials_side_by_side_have_the_results_of_one_by_one(spark):
    data, names = modelled(spark), ["a", "b", "c"]
    trials = [("logistic", {"C": 0.5}), ("forest", {"numTrees": 3, "maxDepth": 3}), ("logistic", {"C": 0.01})]
    one, four = (search.search(data, names, trials, n).collect() for n in (1, 4))
    assert one == four and [r["trial"] for r in one] == [0, 1, 2]
    fitted = ml.score(ml.fit(data.where("split = 'train'"), names, "logistic", C=0.5), data.where("split = 'val'"), names)
    assert one[0]["val_auc_pr"] == pytest.approx(ml.metrics.ranking_metrics(fitted).first()["auc_pr"])


def test_adaptive_search_repeats_for_a_seed(spark):
    data = modelled(spark)
    spaces = {"logistic": {"C": (0.01, 10.0, False, True)}}
    found, trials = search.adaptive_search(data, ["a", "b"], 9, ("logistic",), 5, 4, spaces)
    assert found.count() == len(trials) == 9
    assert trials == search.adaptive_search(data, ["a", "b"], 9, ("logistic",), 5, 4, spaces)[1]


def test_tasks_run_at_the_same_time_and_keep_their_order(spark):
    met = threading.Barrier(3, timeout=20)

    def task(k):
        met.wait()
        time.sleep(0.1 * (3 - k))
        return k, spark.range(10 + k).count()

    assert search.side_by_side(spark, [lambda k=k: task(k) for k in range(3)], 3) == [(0, 10), (1, 11), (2, 12)]
    with pytest.raises(ZeroDivisionError):
        search.side_by_side(spark, [lambda: 1 // 0], 2)
