"""Sources, sinks and composite runs by what they write."""

import json
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_operators import cycles_frame, frame, ts
from tests.test_sources_and_plans import modelled
from vigia.operators import contract, drift, encoding, governance, profile, scorecard, serving, splits
from vigia.plans import canonical, ml, pipelines
from vigia.sources import readers, sinks
from vigia.streaming import jobs

SF = "/root/testdata/sf0.001"
TELEMETRY = "TAG string, Data_Evento timestamp, Alarme string, Is_Dont_Go int, Criticidade string, extra string"


@pytest.fixture
def telemetry(spark, tmp_path):
    for month, rows in {"jan": [("X1", ts("2026-01-01"), "Overheat", 0, "i", "e"), ("X2", ts("2026-01-02"), "Other", 1, "i", "e")], "feb": [("X1", ts("2026-02-01"), "Other", 0, "i", "e"), ("X1", ts("2026-02-01"), "Overheat", 1, "i", "e")]}.items():
        frame(spark, rows, TELEMETRY).toPandas().to_parquet(tmp_path / f"telemetry_{month}.parquet", coerce_timestamps="us")
    frame(spark, [("Z", ts("2026-03-01"), "Overheat", 1, "i", "e")], TELEMETRY).toPandas().to_parquet(tmp_path / "other.parquet", coerce_timestamps="us")
    (tmp_path / "rules.csv").write_text("TIPO,EVENTO,SITUACAO,NIVEL\nALARME OEM,Overheat,x,Muito Alto\n")
    return str(tmp_path)


def test_telemetry_files_and_their_audit(spark, telemetry):
    events, audit = readers.critical_events_from(spark, telemetry, readers.read_rules(spark, f"{telemetry}/rules.csv"))
    assert {(r["TAG"], r["EVENT_TIME"].month) for r in events.collect()} == {("X1", 1), ("X2", 1), ("X1", 2)}
    got = {r["arquivo"]: (r["rows"], r["event_matches"], r["flag_matches"], r["critical_rows"]) for r in audit.collect()}
    assert got == {"telemetry_jan.parquet": (2, 1, 1, 2), "telemetry_feb.parquet": (2, 1, 1, 1)}
    pruned = readers.read_telemetry(spark, telemetry, ["TAG", "Alarme", "missing"])
    assert pruned.columns == ["TAG", "Alarme", "arquivo"]
    plan = pruned._jdf.queryExecution().toString()
    assert "ReadSchema: struct<TAG:string,Alarme:string>" in plan
    assert {(r["arquivo"], r["linhas"]) for r in readers.file_inventory(spark, telemetry).collect()} == {("telemetry_jan.parquet", 2), ("telemetry_feb.parquet", 2), ("other.parquet", 1)}


def test_tables_by_suffix_or_content(spark, tmp_path):
    rows = frame(spark, [(1, "a"), (2, "b")], "x long, y string")
    rows.write.parquet(str(tmp_path / "p"))
    rows.write.option("header", True).csv(str(tmp_path / "c"))
    assert readers.read_table(spark, str(tmp_path / "p")).count() == 2
    assert {r["y"] for r in readers.read_table(spark, str(tmp_path / "c")).collect()} == {"a", "b"}
    (tmp_path / "none").mkdir()
    for path in ("none", "x.xlsx"):
        with pytest.raises(ValueError):
            readers.read_table(spark, str(tmp_path / path))
    with pytest.raises(FileNotFoundError):
        readers.find_cycles(spark, str(tmp_path / "none"))


def test_splits_scores_and_rankings_come_back(spark, tmp_path):
    rows = frame(spark, [("m1", "train", 0.1), ("m1", "test", 0.2), ("m2", "test", 0.3)], "model_name string, split string, score double")
    sinks.write_partitioned(rows, str(tmp_path / "scores"), "model_name", "split")
    assert {tuple(r) for r in readers.read_split(spark, str(tmp_path / "scores"), "test").select("model_name", "score").collect()} == {("m1", 0.2), ("m2", 0.3)}
    for name in ("s.csv", "s.parquet"):
        sinks.write_scores(rows, str(tmp_path / name))
        assert sorted(float(r["score"]) for r in readers.read_table(spark, str(tmp_path / name)).collect()) == [0.1, 0.2, 0.3]
    ranking = frame(spark, [("2026-01-01", "2", "0.5", "A"), ("2026-01-02", "1", "bad", "B"), ("2026-01-02", "0", "0.7", "C")], "data string, rank string, score string, Tag string")
    sinks.write_csv(ranking, str(tmp_path / "ranking"))
    got = [tuple(r) for r in readers.read_priority(spark, str(tmp_path / "ranking")).select("Tag", "rank", "score").collect()]
    assert got == [("C", 0, 0.7), ("B", 1, None), ("A", 2, 0.5)]


def test_encoder_comes_back_with_operators(spark, tmp_path):
    train = canonical.labeled(spark, SF)
    sinks.write_encoder(encoding.fit_encoder(train), str(tmp_path / "e"))
    back = sinks.read_encoder(spark, str(tmp_path / "e"))
    assert "Operador_freq" in back
    a, b = (sorted(map(str, encoding.transform(train, e).select("Id", "Tag_freq", "Operador_freq", "Classe_target_enc", "Frota_F0").collect())) for e in (encoding.fit_encoder(train), back))
    assert a == b
    sinks.write_encoder(encoding.fit_encoder(train.drop("Matricula_Operador_Hash")), str(tmp_path / "f"))
    assert "Operador_freq" not in sinks.read_encoder(spark, str(tmp_path / "f"))
    sinks.write_table(train.limit(0).select("Tag"), str(tmp_path / "f" / "Tag_freq"))
    with pytest.raises(ValueError):
        sinks.read_encoder(spark, str(tmp_path / "f"))


def test_label_to_segments(spark, tmp_path, telemetry):
    """Labels, features, baseline, operations and segments in one chain of files."""
    out = str(tmp_path / "out")
    small = frame(spark, [(1, ts("2026-01-01"), ts("2025-12-31 22:00"), "X1"), (2, ts("2026-01-01"), ts("2026-01-01 12:00"), "X2")], "Id long, Inicio timestamp, Fim timestamp, Tag string")
    assert {r["Id"]: r["target_4h"] for r in pipelines.label(spark, small, telemetry, f"{telemetry}/rules.csv", out).collect()} == {1: 1, 2: 0}
    assert sum(json.loads(line)["rows"] for p in (tmp_path / "out" / "audit").glob("*.json") for line in p.read_text().splitlines()) == 4
    canonical.labeled(spark, SF).write.mode("overwrite").parquet(f"{out}/labeled")
    canonical.errors(spark, SF).write.mode("overwrite").parquet(f"{out}/critical_events")
    data = pipelines.build_features(spark, out)
    assert data.count() == canonical.cycles(spark, SF).count() and (tmp_path / "out" / "feature_report").exists()
    found = {r["split"]: r["rows"] for r in pipelines.baseline(spark, data, out).collect()}
    cut = {r["split"]: r["rows"] for r in splits.split_metadata(splits.temporal_split(data)).collect()}
    assert found == {k: v for k, v in cut.items() if k != "embargo"}
    scores = spark.read.parquet(f"{out}/scores")
    assert {r["split"]: r["count"] for r in scores.groupBy("split").count().collect()} == found and sinks.read_encoder(spark, f"{out}/encoder")
    scored = scorecard.scored_frame(scores, F.col("score"), 0.1)
    pipelines.operations(scored, f"{out}/ops")
    pipelines.segments(scored, f"{out}/seg")
    top = spark.read.option("header", True).csv(f"{out}/ops/topk")
    assert {(r["split"], r["top_k_tags_per_day"]) for r in top.collect()} == {(s, str(k)) for s in found for k in (3, 5, 10, 15, 20)}
    for name in ("ops/threshold", "ops/budgets", "ops/extreme_fn", "seg/segment_threshold", "seg/segment_topk", "seg/hotspots", "seg/segment_lists"):
        assert spark.read.option("header", True).csv(f"{out}/{name}").columns
    assert spark.read.json(f"{out}/ops/dedup").first()["split"] == "test"
    tables = pipelines.explore(spark.read.parquet(f"{out}/labeled"))
    assert {"summary", "boxes", "spearman", "weekday_hour"} <= set(tables) and tables["hours"].count() == 24 and tables["summary"].first()["ciclos"] == data.count()


def test_drift_runs(spark, tmp_path):
    rows = canonical.scored(spark, SF).withColumn("hora", F.hour("Fim").cast("double"))
    base = str(tmp_path / "base")
    table = pipelines.drift_baseline(rows, ["hora", "score"], base, ["Frota"])
    assert {r["feature"] for r in table.collect()} == {"hora", "score"}
    same = pipelines.drift_check(rows, base, str(tmp_path / "a")).first()
    assert not same["retreinar"] and spark.read.json(str(tmp_path / "a" / "drift")).first()["retreinar"] is False
    moved = rows.withColumns({"score": F.col("score") / 10, "Frota": F.lit("new")})
    assert pipelines.drift_check(moved, base, str(tmp_path / "b")).first()["motivos"] == "score,categorias"
    pipelines.drift_baseline(rows, ["hora", "score"], str(tmp_path / "plain"))
    assert pipelines.drift_check(moved, str(tmp_path / "plain"), str(tmp_path / "c")).first()["motivos"] == "score"


def test_drift_stream_replaces_a_repeated_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 97).cast("double").alias("x"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = drift.reference_profile(rows, ["x"])
    for k in range(2):  # a second run with a new checkpoint is a retried batch 0
        jobs.watch_drift(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "d"), str(tmp_path / f"c{k}")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "d")).collect()
    assert [(r["lote"], r["faixa"]) for r in got] == [(0, "estavel")]


def test_selection_writes_all_evidence(spark, tmp_path):
    data, names = modelled(spark), ["n_alertas_24h", "n_alertas_4h"]
    out = str(tmp_path / "m")
    trials = [("logistic", {"C": 0.5}), ("forest", {"numTrees": 3, "maxDepth": 3}), ("forest", {"numTrees": 4, "maxDepth": 3})]
    found = pipelines.select_model(spark, data, names, trials, out, calibrated=True)
    assert {r["split"] for r in found.collect()} == {"train", "val", "test"}
    per = {(r["model_name"], r["split"]): r["count"] for r in spark.read.parquet(f"{out}/scores").groupBy("model_name", "split").count().collect()}
    assert len({m for m, _ in per}) == 2 and {v for (_, s), v in per.items() if s == "test"} == {data.where("split = 'test'").count()}
    scores = spark.read.parquet(f"{out}/scores").agg(F.min("score"), F.max("score")).first()
    assert 0 <= scores[0] and scores[1] <= 1
    assert spark.read.parquet(f"{out}/backtest").count() == 3
    curve = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/threshold_curve")
    assert curve.count() >= 1 and {"threshold", "precision", "recall"} <= set(curve.columns)
    assert {r["feature"] for r in spark.read.option("header", True).csv(f"{out}/importance").collect()} == set(names)
    report = readers.read_report(spark, f"{out}/report", ["model_name", "params", "selection_rule", "data_digest", "config_sha256", "precision_at_k", "backtest"]).first()
    assert {m["metrica"] for m in report["backtest"]} == {"test_top15_precision_at_k", "test_top15_recall_at_k"} and report["data_rows"] == 400


def batch_files(spark, folder, names):
    folder.mkdir(exist_ok=True)
    for name, tag in names.items():
        rows = modelled(spark).select("Id", F.lit(tag).cast("string").alias("Tag"), "Fim", "n_alertas_24h", "n_alertas_4h").limit(10)
        pq.write_table(rows.toArrow(), folder / name)


def test_daily_batches_are_archived_and_repeatable(spark, tmp_path):
    data, names, out = modelled(spark), ["n_alertas_24h", "n_alertas_4h"], str(tmp_path / "out")
    pipelines.select_model(spark, data, names, [("logistic", {})], str(tmp_path / "m"))
    folder = tmp_path / "in"
    batch_files(spark, folder, {"a.parquet": "A", "bad1.parquet": None})
    (folder / "notes.txt").write_text("left alone")
    first = {r["batch_id"]: r for r in pipelines.daily_batches(spark, str(folder), str(tmp_path / "m"), out).collect()}
    assert first["a.parquet"]["accepted"] and not first["bad1.parquet"]["accepted"] and first["bad1.parquet"]["motivo"] == "Tag not_null"
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["notes.txt"]
    assert (tmp_path / "out" / "archive" / "processed" / "a.parquet").exists() and (tmp_path / "out" / "archive" / "rejected" / "bad1.parquet").exists()
    batch_files(spark, folder, {"a.parquet": "A", "bad2.parquet": None})
    pipelines.daily_batches(spark, str(folder), str(tmp_path / "m"), out)
    count = lambda name: {r["batch_id"]: r["count"] for r in spark.read.parquet(f"{out}/{name}").groupBy("batch_id").count().collect()}
    assert count("scores") == {"a.parquet": 10} and count("rejected") == {"bad1.parquet": 10, "bad2.parquet": 10}


def test_a_bad_file_stops_no_other(spark, tmp_path):
    data, names, out = modelled(spark), ["n_alertas_24h", "n_alertas_4h"], str(tmp_path / "out")
    pipelines.select_model(spark, data, names, [("logistic", {})], str(tmp_path / "m"))
    folder = tmp_path / "in"
    batch_files(spark, folder, {"a.parquet": "A", "b.parquet": "B", "c.parquet": "C"})
    good = (folder / "a.parquet").read_bytes()
    (folder / "torn.parquet").write_bytes(good[: len(good) // 2])
    (folder / "zero.parquet").write_bytes(b"")
    middle = bytearray(good)
    middle[4:60] = b"\xff" * 56  # the footer is whole, the first column isn't
    (folder / "spoilt.parquet").write_bytes(middle)
    (folder / "d.csv").write_text("Id,Tag,Fim,n_alertas_24h,n_alertas_4h,more\n1,D,2025-01-01 10:00:00,3,1,x\n2,D,2025-01-01 11:00:00,x,1,y\n")
    (folder / "head.csv").write_text("Id,Tag,Fim,n_alertas_24h,n_alertas_4h\n")
    rows, bad = readers.read_batches(spark, str(folder), {"Tag": "string", "Fim": "timestamp", "n_alertas_24h": "double", "n_alertas_4h": "double"})
    assert {r["batch_id"]: r["count"] for r in rows.groupBy("batch_id").count().collect()} == {"a.parquet": 10, "b.parquet": 10, "c.parquet": 10, "d.csv": 2}
    assert {r["batch_id"] for r in bad.collect()} == {"torn.parquet", "zero.parquet", "spoilt.parquet"}
    log = {r["batch_id"]: (r["accepted"], r["rows"]) for r in pipelines.daily_batches(spark, str(folder), str(tmp_path / "m"), out).collect()}
    assert {k: v for k, v in log.items() if not v[0]} == dict.fromkeys(["torn.parquet", "zero.parquet", "spoilt.parquet", "head.csv"], (False, 0))
    assert log["a.parquet"] == (True, 10) and log["d.csv"] == (True, 2)
    assert sorted(p.name for p in (tmp_path / "out" / "archive" / "rejected").iterdir() if not p.name.startswith(".")) == ["head.csv", "spoilt.parquet", "torn.parquet", "zero.parquet"]
    assert spark.read.parquet(f"{out}/scores").where("batch_id = 'd.csv' and score is not null").count() == 2


def test_batch_stream_judges_each_drop(spark, tmp_path):
    data, names, out = modelled(spark), ["n_alertas_24h", "n_alertas_4h"], str(tmp_path / "out")
    pipelines.select_model(spark, data, names, [("logistic", {})], str(tmp_path / "m"))
    folder = tmp_path / "in"
    batch_files(spark, folder, {"a.parquet": "A", "bad.parquet": None})
    (folder / "torn.parquet").write_bytes((folder / "a.parquet").read_bytes()[:-40])
    for k in range(2):  # the same files again, as after a lost checkpoint
        pipelines.watch_batches(spark, str(folder), str(tmp_path / "m"), out, str(tmp_path / f"c{k}")).awaitTermination(120)
    assert {(r["batch_id"], r["accepted"], r["rows"]) for r in spark.read.parquet(f"{out}/verdicts").collect()} == {("a.parquet", True, 10), ("bad.parquet", False, 10), ("torn.parquet", False, 0)}
    assert spark.read.parquet(f"{out}/scores").count() == spark.read.parquet(f"{out}/rejected").count() == 10


def test_leaky_encodings_see_all_times(spark):
    rows = cycles_frame(spark, 300).withColumn("Tag", F.when(F.col("Id") >= 240, F.lit("late")).otherwise(F.col("Tag")))
    leaky, clean = splits.temporal_split(ml.leaky_encodings(rows), embargo_hours=0.0), splits.temporal_split(rows)
    coder = encoding.fit_encoder(clean.where("split = 'train'"))
    freq = lambda df: {r["Tag"]: round(r["Tag_freq"], 6) for r in df.select("Tag", "Tag_freq").distinct().collect()}
    assert freq(leaky)["late"] == 0.2 and freq(encoding.transform(clean.where("split = 'test'"), coder))["late"] == 0.0
    assert {"Tag_freq", "Classe_target_enc", "Frota_F0", "Tipo_Caminhao"} <= set(ml.modelled_columns(leaky))
    got = {r["metrica"]: r for r in ml.leakage_ablation(rows).collect()}
    assert set(got) == {"precision_at_k", "recall_at_k", "lift_at_k", "auc_pr"} and all(r["ganho"] == pytest.approx(r["novo"] - r["base"]) for r in got.values())
    assert governance.same_rows(rows, rows.select("Fim", "Id")) and not governance.same_rows(rows, rows.limit(10))


def test_trials_are_drawn_from_their_spaces():
    trials = ml.propose_trials(4)
    assert trials == ml.propose_trials(4) != ml.propose_trials(4, seed=1) and len(trials) == 12
    for kind, params in trials:
        for name, (low, high, whole, _) in ml.SPACES[kind].items():
            assert low <= params[name] <= high and (not whole or isinstance(params[name], int))


def test_permutation_importance_finds_the_feature(spark):
    rows = cycles_frame(spark, 400).withColumns({"good": F.col("target_4h").cast("double") + (F.col("Id") % 3) / 10, "noise": (F.col("Id") * 37 % 101).cast("double")})
    got = {r["feature"]: r["importance"] for r in ml.importance(ml.fit(rows, ["good", "noise"]), rows, ["good", "noise"]).collect()}
    assert got["good"] > 0.3 and abs(got["noise"]) < 0.1


def test_inference_rejects_and_ranks(spark):
    data = modelled(spark)
    model = ml.fit(data, ["n_alertas_24h", "n_alertas_4h"])
    batch = data.withColumn("dias_desde_ultimo_alerta", F.lit(2.0)).withColumn("turno", F.lit("noite"))
    scored, top = ml.inference(batch, model, ["n_alertas_24h", "n_alertas_4h"], 0.5, top_k=2)
    assert scored.count() == 400 and top.groupBy("data").count().agg(F.max("count")).first()[0] == 2
    with pytest.raises(ValueError):
        ml.inference(batch.withColumn("Tag", F.lit(None).cast("string")), model, ["n_alertas_24h"], 0.5)
    with pytest.raises(ValueError):
        ml.inference(batch.drop("n_alertas_4h"), model, ["n_alertas_24h", "n_alertas_4h"], 0.5)


def test_sample_and_fingerprint(spark):
    rows = cycles_frame(spark, 300)
    a, b = ({r["Id"] for r in splits.repeatable_sample(df, 50).collect()} for df in (rows, rows.repartition(7)))
    assert a == b and len(a) == 50 and splits.repeatable_sample(rows, 1000).count() == 300
    one, two = governance.fingerprint(rows).first(), governance.fingerprint(rows.repartition(5)).first()
    assert one == two and one["rows"] == 300
    assert governance.fingerprint(rows.withColumn("target_4h", F.when(F.col("Id") == 7, 5).otherwise(F.col("target_4h")))).first()["digest"] != one["digest"]
    hashed = {tuple(r) for r in governance.config_hash(frame(spark, [(1, "a"), (1, "a"), (2, "a")], "x int, y string"), ["x", "y"]).select("x", "config_sha256").collect()}
    assert len(hashed) == 2


def test_families_and_exclusions(spark):
    rows = [("hora_do_dia", 0.4), ("n_ciclos_4h", 0.3), ("duracao_media_ciclo_8h", 0.2), ("n_alertas_4h", 0.5), ("delta_x", 0.1), ("dias_desde_ultimo_alerta", 0.1), ("Tag_freq", 0.05), ("Frota_A", 0.05), ("other", 0.01)]
    got = {r["familia"]: (round(r["importancia"], 6), r["principais"]) for r in profile.family_importance(frame(spark, rows, "feature string, importance double"), 2).collect()}
    f = profile.FAMILIES
    assert got[f[0]] == (0.4, "hora_do_dia") and got[f[1]] == (0.5, "n_ciclos_4h,duracao_media_ciclo_8h") and got[f[5]] == (0.1, "Frota_A,Tag_freq") and len(got) == 7
    excluded = {r["grupo"]: (r["colunas"], r["n"]) for r in contract.excluded_columns(cycles_frame(spark, 3).withColumn("mes", F.lit(1))).collect()}
    assert excluded["nao_modelavel"] == ("mes", 1) and excluded["nao_numerica"] == ("Frota,Tipo", 2) and excluded["vazamento"][1] == 6


def test_equipment_slices_and_performance(spark):
    cycles, events = cycles_frame(spark, 300), frame(spark, [("CA0", ts("2026-01-02")), ("CA9", ts("2026-01-03"))], "Tag string, EVENT_TIME timestamp")
    priority = frame(spark, [("CA0", datetime(2026, 1, 2).date(), k, 0.5) for k in range(1, 41)], "Tag string, data date, rank int, score double")
    got = {r["Tag"]: r for r in serving.equipment_slices(cycles, events, priority).collect()}
    assert [x["Id"] for x in got["CA0"]["cycles"]] == list(range(295, 295 - 5 * 40, -5)) and len(got["CA0"]["rankings"]) == 30 and len(got["CA0"]["events"]) == 1
    assert got["CA9"]["cycles"] is None and len(got["CA9"]["events"]) == 1 and len(got) == 6
    hot = frame(spark, [(f"T{k:02}", k) for k in range(30)], "Tag string, positive_days long")
    one = serving.performance(hot.limit(2), hot.limit(3), hot).first()
    assert (len(one["topk"]), len(one["budgets"]), len(one["hotspots"])) == (2, 3, 20) and min(h["positive_days"] for h in one["hotspots"]) == 10


def test_alignment_and_flattening(spark):
    rows = encoding.align_columns(frame(spark, [(1, True)], "x int, Frota_A boolean"), ["x", "Frota_A", "Frota_B", "Tag_freq"])
    assert rows.first().asDict() == {"x": 1, "Frota_A": True, "Frota_B": False, "Tag_freq": 0.0}
    nested = frame(spark, [("m", (1.0, 2.0))], "name string, test struct<p: double, r: double>")
    assert governance.flatten(nested, ["test"]).first().asDict() == {"name": "m", "test_p": 1.0, "test_r": 2.0}
    assert contract.feature_columns(cycles_frame(spark, 2)) == ["duracao_ciclo_min"]
    with pytest.raises(ValueError):
        contract.feature_columns(frame(spark, [("a",)], "Tag string"))
    aligned = contract.align_features(frame(spark, [(1.0, 2.0)], "b double, extra double"), ["a", "b"], allow_missing=True)
    assert aligned.columns == ["extra", "a", "b"] and aligned.first()["a"] == 0.0 and contract.feature_coverage(["b", "c"], ["a", "b"]) == (["a"], ["c"])
