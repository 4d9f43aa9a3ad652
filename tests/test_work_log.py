"""The work log: last entry wins, and a crash between any two steps of a compaction loses nothing."""

import random

import pytest
from pyspark.sql import functions as F

from vigia.operators import profile, scorecard, serving
from vigia.plans import canonical, pipelines
from vigia.sources import readers
from vigia.sources.work_log import WorkLog

SF = "/root/testdata/sf0.001"


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, status string, note string, updated_at string")


def shown(log):
    return {r["key"]: (r["status"], r["note"], r["updated_at"]) for r in log.read().collect()}


def filled(spark, path, rounds=3, compact=True):
    log, want, draw = WorkLog(spark, path), {}, random.Random(1)
    for k in range(rounds):
        rows = [(f"k{draw.randrange(6)}", draw.choice(serving.STATUSES), f"n{k}", f"2025-01-0{k + 1}T00:00:0{j}") for j in range(5)]
        log.append(entries(spark, *rows))
        for r in sorted(rows, key=lambda r: r[3]):
            want[r[0]] = r[1:]
        if compact:
            assert log.compact() == k + 1
    return log, want


def test_reading_after_compactions(spark, tmp_path):
    log, want = filled(spark, str(tmp_path / "log"))
    assert shown(log) == want and log.compact() == 3  # nothing new
    # The newest snapshot and the one before are there, and the entries of the last one.
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")) == ["base-2", "base-3", "entries"]
    log.append(entries(spark, ("k0", "concluido", None, "2024-01-01T00:00:00")))  # older than what is known
    assert shown(log) == {"k0": ("concluido", None, "2024-01-01T00:00:00")} | want
    # Of the entries those that the snapshot before had taken in are gone: the third round's and the last one are left.
    left = spark.read.parquet(*log._entries()).select("note").distinct().collect()
    assert {r["note"] for r in left} == {"n2", None}


@pytest.mark.parametrize("step", ["_write_snapshot", "_list_taken", "_switch", "_clean"])
@pytest.mark.parametrize("after", [False, True])
def test_a_crash_loses_nothing(spark, tmp_path, monkeypatch, step, after):
    log, want = filled(spark, str(tmp_path / "log"), 2)
    log.append(entries(spark, ("new", "pendente", "x", "2025-02-01T00:00:00")))
    want["new"] = ("pendente", "x", "2025-02-01T00:00:00")
    own = getattr(log, step)

    def dies(*given):
        if after:
            own(*given)
        raise OSError("power cut")

    monkeypatch.setattr(log, step, dies)
    with pytest.raises(OSError):
        log.compact()
    again = WorkLog(spark, str(tmp_path / "log"))
    assert shown(again) == want
    again.append(entries(spark, ("new", "concluido", "y", "2025-02-02T00:00:00")))
    want["new"] = ("concluido", "y", "2025-02-02T00:00:00")
    again.compact()
    assert shown(again) == want


def test_a_reader_outlives_one_compaction(spark, tmp_path):
    log, want = filled(spark, str(tmp_path / "log"), 2)
    log.append(entries(spark, ("k9", "pendente", "", "2025-03-01T00:00:00")))
    read = log.read()
    log.compact()
    assert {r["key"] for r in read.collect()} == {*want, "k9"}


def test_an_empty_log_and_entries_without_time(spark, tmp_path):
    log = WorkLog(spark, str(tmp_path / "log"))
    assert shown(log) == {} and log.compact() == 0
    log.append(spark.createDataFrame([("a", "pendente")], "key string, status string"))
    assert shown(log)["a"][0] == "pendente" and shown(log)["a"][2] > "2025"


# --- views in full


def test_exploration_is_written(spark, tmp_path):
    rules = spark.createDataFrame([("A", "x", "y", "alto"), ("A", "z", "y", "alto"), ("B", "x", "y", None)], "TIPO string, EVENTO string, SITUACAO string, NIVEL string")
    names = pipelines.write_exploration(canonical.labeled(spark, SF), str(tmp_path), canonical.telemetry(spark, SF), rules)
    assert {"summary", "alerts", "alert_tags", "alert_period", "rules"} <= set(names)
    tables = {n: spark.read.option("header", True).csv(str(tmp_path / n)) for n in names}
    assert {(r["TIPO"], r["NIVEL"], r["regras"]) for r in tables["rules"].collect()} == {("A", "alto", "2"), ("B", None, "1")}
    assert tables["hours"].count() == 24 and all(t.columns for t in tables.values())
    assert profile.alert_tags(canonical.telemetry(spark, SF).limit(0)).count() == 0


def test_performance_has_all_its_fields(spark):
    scored = canonical.scored(spark, SF)
    panel = scorecard.tag_day_panel(scored.where("split is not null"), ["split"])
    manifest = spark.createDataFrame([("gbt_1", 0.4, "val recall", ["a"])], "model_name string, threshold double, selection_rule string, feature_columns array<string>")
    one = serving.performance(scorecard.topk_metrics(panel, ["split"]), scorecard.budget_metrics(scored.where("split is not null")), scorecard.tag_hotspots(scored), scored.groupBy("split").count(), scorecard.dedup_summary(scored), manifest).collect()
    assert len(one) == 1 and (one[0]["model_id"], one[0]["threshold"], one[0]["rule"]) == ("gbt_1", 0.4, "val recall")
    assert 0 < len(one[0]["hotspots"]) <= 20 and len(one[0]["dedup"]) == 1 and {r["split"] for r in one[0]["topk"]} >= {"train", "test"} and one[0]["thresholds"]


def test_backtest_report_from_csv(spark, tmp_path):
    spark.createDataFrame([(0, 0.5, "x"), (1, 0.75, "y")], "fold int, test_recall double, note string").write.option("header", True).csv(str(tmp_path / "b"))
    found = readers.read_backtest(spark, str(tmp_path / "b"), ["test_recall"])
    assert found.agg(F.avg("test_recall")).first()[0] == 0.625
    with pytest.raises(ValueError, match="lacks"):
        readers.read_backtest(spark, str(tmp_path / "b"), ["test_precision"])
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("fold,test_recall\n")
    with pytest.raises(ValueError, match="folds"):
        readers.read_backtest(spark, str(tmp_path / "none"))
