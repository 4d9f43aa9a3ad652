"""As-of joins and time windows against brute force, with ties, nulls, hot days; their plans and their growth."""

import datetime as dt
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigia.operators.asof import interval_counts, nearest
from vigia.operators.features import cycle_rolling

START = dt.datetime(2025, 3, 1, tzinfo=dt.UTC)
HOUR = 3_600_000_000


def cycles_frame(spark, rows):
    return spark.createDataFrame(rows, "Id long, Tag string, Classe string, Fim timestamp, duracao_ciclo_min double")


def random_cycles(n, seed, days=3):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        fim = None if draw.random() < 0.03 else START + dt.timedelta(minutes=draw.randrange(0, days * 1440, 10))
        rows.append((k, draw.choice(["A", "B", None]), draw.choice(["x", "y", "z", None]), fim, draw.choice([None, float("nan"), 7.25, draw.randrange(600) / 60])))
    return rows


def brute_rolling(rows, hours):
    out = {}
    for k, tag, kind, fim, _ in rows:
        for h in hours:
            seen = [] if fim is None or tag is None else [r for r in rows if r[1] == tag and r[3] is not None and fim - dt.timedelta(hours=h) <= r[3] < fim]
            d = [r[4] for r in seen if r[4] is not None and not np.isnan(r[4])]
            classes = [r[2] or "nan" for r in seen]
            known = fim is not None and tag is not None
            out[k, h] = (
                float(len(seen)) if seen else None,
                float(np.mean(d)) if d else None,
                float(np.std(d, ddof=1)) if len(d) > 1 else None,
                float(len(set(classes))) if known else None,
                (classes.count(kind or "nan") / len(seen) if seen else 0.0) if known else None,
            )
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rolling_matches_brute_force(spark, seed):
    rows, hours = random_cycles(160, seed), (4, 24)
    want = brute_rolling(rows, hours)
    got = cycle_rolling(cycles_frame(spark, rows), hours=hours).collect()
    assert len(got) == len(rows)
    for r in got:
        for h in hours:
            mine = [r[f"{c}_{h}h"] for c in ("n_ciclos", "duracao_media_ciclo", "duracao_std_ciclo", "n_classes_distintas", "freq_classe_atividade")]
            assert mine == [None if x is None else pytest.approx(x, abs=1e-9) for x in want[r["Id"], h]], (r["Id"], h)


def test_equal_durations_have_no_deviation(spark):
    rows = [(k, "A", "x", START + dt.timedelta(seconds=k), 1e6 / 3) for k in range(50)]
    last = {r["Id"]: r for r in cycle_rolling(cycles_frame(spark, rows), hours=(4,)).collect()}[49]
    assert last["duracao_std_ciclo_4h"] == 0.0 and last["n_ciclos_4h"] == 49


def test_a_class_leaves_at_the_window_edge(spark):
    at = lambda h, us=0: START + dt.timedelta(hours=h, microseconds=us)
    rows = [(0, "A", "x", at(22), 1.0), (1, "A", "y", at(26), 1.0), (2, "A", "z", at(26, 1), 1.0), (3, "A", "x", at(30, 1), 1.0)]
    got = {r["Id"]: r["n_classes_distintas_4h"] for r in cycle_rolling(cycles_frame(spark, rows), hours=(4,)).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 1.0, 3: 1.0}


def test_nearest_and_counts_match_brute_force(spark):
    draw = random.Random(5)
    left = random_cycles(150, 9)
    right = [(draw.choice(["A", "B", None]), None if draw.random() < 0.05 else START + dt.timedelta(minutes=draw.randrange(-1440, 4 * 1440, 30)), k) for k in range(90)]
    cycles, events = cycles_frame(spark, left), spark.createDataFrame(right, "TAG string, at timestamp, no long")
    df = cycles
    for after in (True, False):
        df = nearest(df, events, "Fim", "at", right_tag="TAG", after=after, payload=["no"], name="near_after" if after else "near_before")
    df = interval_counts(df, events, "Fim", "at", {"n1": HOUR, "n24": 24 * HOUR}, right_tag="TAG")
    got = {r["Id"]: r for r in df.collect()}
    assert len(got) == len(left)
    for k, tag, _, fim, _ in left:
        mine = [] if fim is None or tag is None else [(at, no) for t, at, no in right if t == tag and at is not None]
        later, sooner = [x for x in mine if x[0] > fim], [x for x in mine if x[0] < fim]
        assert (got[k]["near_after"] and got[k]["near_after"]["no"]) == (min(later)[1] if later else None)
        assert (got[k]["near_before"] and got[k]["near_before"]["no"]) == (max(sooner)[1] if sooner else None)
        for name, hours in (("n1", 1), ("n24", 24)):
            assert got[k][name] == sum(fim - dt.timedelta(hours=hours) <= at < fim for at, _ in mine)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def hot_day(spark, n):
    us = F.col("id") * int(86_000e6 / n)
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("Id"), F.lit("A").alias("Tag"), F.concat(F.lit("k"), F.col("id") % 40).alias("Classe"), F.timestamp_micros(us + int(START.timestamp()) * 1_000_000).alias("Fim"), (F.col("id") % 97).cast("double").alias("duracao_ciclo_min"))
    return rows, rows.select(F.col("Tag").alias("TAG"), F.col("Fim").alias("at"))


def all_windows(spark, n):
    cycles, events = hot_day(spark, n)
    df = nearest(cycle_rolling(cycles), events, "Fim", "at", right_tag="TAG", name="near")
    return interval_counts(df, events, "Fim", "at", {"n4": 4 * HOUR}, right_tag="TAG")


def test_every_frame_only_grows(spark):
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^,()]+)", plan_of(all_windows(spark, 100)).lower())
    assert frames
    # Growing, whole, or one neighbour: none slides, none shrinks.
    assert all(low == "unboundedpreceding$()" or (low == high) for _, low, high in frames), frames


def test_windows_share_their_shuffle(spark):
    plan = cycle_rolling(cycles_frame(spark, random_cycles(20, 0)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_time_is_linear_in_the_rows_of_a_tag_day(spark):
    def seconds(n):
        began = time.time()
        all_windows(spark, n).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(1_000)
    small, large = seconds(8_000), seconds(64_000)
    # Eight times the rows; the sliding frames before took a minute for 16,000 rows, and 64 times as long for 64,000.
    assert large < 10 * small + 10, (small, large)
