"""Hand-computed cases of single operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigia.functions.scalar import utc_time
from vigia.operators import contract, drift, encoding, features, governance, labeling, metrics, ranking, scorecard, serving, splits


def ts(text):
    return datetime.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def cycles_frame(spark, n=200, positives_every=4):
    start = ts("2026-01-01")
    rows = [
        (i, start + timedelta(hours=i), start + timedelta(hours=i, minutes=30), f"CA{i % 5}", f"F{i % 2}", "Caminhao" if i % 2 else "Carregadeira", "Parado" if i % 3 == 0 else "Operando", 30.0, int(i % positives_every == 0))
        for i in range(n)
    ]
    return frame(spark, rows, "Id long, Inicio timestamp, Fim timestamp, Tag string, Frota string, Tipo string, Classe string, duracao_ciclo_min double, target_4h int")


EVENTS = "TAG string, EVENT_TIME timestamp"


def test_critical_events_by_event_and_flag(spark):
    telemetry = frame(spark, [("A", "2026-01-01 10:00", "Overheat", 0), ("B", "2026-01-01 11:00", "Unknown Alarm", 1), ("C", "2026-01-01 12:00", "Another Alarm", 0)], "TAG string, Data_Evento string, Alarme string, Is_Dont_Go int")
    rules = frame(spark, [("ALARME OEM", "Overheat", "Mediante alarme nível 3", "Muito Alto")], "TIPO string, EVENTO string, SITUACAO string, NIVEL string")
    flagged = labeling.flag_events(labeling.prepare_events(telemetry), labeling.critical_rules(rules))
    assert labeling.critical_events(flagged).count() == 2
    audit = labeling.event_audit(flagged).first()
    assert (audit["event_matches"], audit["flag_matches"]) == (1, 1)


def test_rule_level_falls_back_to_part_of_the_text(spark):
    rules = frame(spark, [("A", "x", "s", "nivel muito alto!"), ("A", "y", "s", "baixo")], "TIPO string, EVENTO string, SITUACAO string, NIVEL string")
    assert [r["EVENTO"] for r in labeling.critical_rules(rules).collect()] == ["x"]


def test_labels(spark):
    cycles = frame(spark, [(1, "A", ts("2026-01-01 08:00")), (2, "A", ts("2026-01-01 09:30")), (3, "A", ts("2026-01-01 15:00")), (4, "B", ts("2026-01-01 10:00")), (5, "A", None)], "Id long, Tag string, Fim timestamp")
    events = frame(spark, [("A", ts("2026-01-01 10:00")), ("A", ts("2026-01-01 10:30")), ("B", ts("2026-01-01 18:30"))], EVENTS)
    got = {r["Id"]: (r["target_4h"], r["tte_horas"]) for r in labeling.label_cycles(cycles, events).collect()}
    assert got == {1: (1, 2.0), 2: (1, 0.5), 3: (0, None), 4: (0, 8.5), 5: (0, None)}


def test_next_event_is_strictly_after_and_may_be_days_away(spark):
    cycles = frame(spark, [(1, "A", ts("2026-01-01 08:00"))], "Id long, Tag string, Fim timestamp")
    events = frame(spark, [("A", ts("2026-01-01 08:00")), ("A", ts("2026-01-04 08:00"))], EVENTS)
    assert labeling.label_cycles(cycles, events).first()["tte_horas"] == 72.0


def test_alert_history(spark):
    cycles = frame(spark, [(1, "A", ts("2026-01-02 12:00"))], "Id long, Tag string, Fim timestamp")
    events = frame(spark, [("A", ts("2026-01-02 09:00")), ("A", ts("2026-01-02 02:00")), ("A", ts("2025-12-03 12:00"))], EVENTS)
    got = features.alert_history(cycles, events).first()
    assert (got["n_alertas_4h"], got["n_alertas_24h"]) == (1, 2)
    assert got["dias_desde_ultimo_alerta"] == pytest.approx(3 / 24)


def test_window_edges_are_closed_left_and_open_right(spark):
    cycles = frame(spark, [(1, "A", ts("2026-01-02 12:00"))], "Id long, Tag string, Fim timestamp")
    events = frame(spark, [("A", ts("2026-01-02 08:00")), ("A", ts("2026-01-02 12:00"))], EVENTS)
    assert features.alert_history(cycles, events).first()["n_alertas_4h"] == 1


def test_maintenance(spark):
    cycles = frame(spark, [(1, "CA0", ts("2026-01-10")), (2, "CA0", ts("2026-01-20")), (3, "CA1", ts("2026-01-20"))], "Id long, Tag string, Fim timestamp")
    orders = frame(spark, [("CA0", ts("2026-01-05"), "corretiva"), ("CA0", ts("2026-01-30"), "corretiva")], "Tag string, data_manutencao timestamp, tipo string")
    got = {r["Id"]: (r["dias_desde_ultima_manutencao"], r["manutencao_corretiva_7d"]) for r in features.maintenance_history(cycles, orders).collect()}
    assert got == {1: (5.0, 1.0), 2: (15.0, 0.0), 3: (None, 0.0)}


def test_times_to_utc(spark):
    texts = ["2026-01-01 10:00:00", "2026-01-01T10:00:00Z", "2018-11-04 00:30:00", "2018-02-17 23:30:00", "not a time", None]
    rows = frame(spark, [(t,) for t in texts], "t string").select(F.date_format(utc_time("t"), "yyyy-MM-dd HH:mm").alias("u"))
    # The fourth lies in an hour that occurs twice, the third in one that doesn't occur.
    assert [r["u"] for r in rows.collect()] == ["2026-01-01 13:00", "2026-01-01 10:00", None, None, None, None]


def test_quality_report(spark):
    a = ("CA0", "F", "T", ts("2026-01-01 00:00"), ts("2026-01-01 01:00"))
    rows = [a, a, ("CA1", "F", "T", ts("2026-01-01 00:00"), ts("2026-01-02 08:30"))]
    got = contract.quality_report(frame(spark, rows, "Tag string, Frota string, Tipo string, Inicio timestamp, Fim timestamp")).first()
    assert (got["rows"], got["duplicate_rows"], got["duplicate_keys"], got["over_max_duration"], got["negative_duration"]) == (3, 1, 1, 1, 0)
    with pytest.raises(ValueError):
        contract.require_columns(frame(spark, rows, "A string, B string, C string, D timestamp, E timestamp"))


@pytest.mark.parametrize(("embargo", "sizes"), [(4.0, (66, 11, 15)), (0.0, (70, 15, 15))])
def test_split_sizes(spark, embargo, sizes):
    got = {r["split"]: r["rows"] for r in splits.split_metadata(splits.temporal_split(cycles_frame(spark, 100), embargo_hours=embargo)).collect()}
    assert (got["train"], got["val"], got["test"]) == sizes


def test_ties_stay_on_one_side(spark):
    start = ts("2026-01-01")
    rows = frame(spark, [(i, start + timedelta(hours=i % 30)) for i in range(300)], "Id long, Fim timestamp")
    got = splits.temporal_split(rows, embargo_hours=0.0).groupBy("Fim").agg(F.countDistinct("split").alias("n"))
    assert got.agg(F.max("n")).first()[0] == 1


def test_encoder_on_unseen_values(spark):
    train = cycles_frame(spark)
    coder = encoding.fit_encoder(train)
    new = frame(spark, [(1, ts("2026-01-01"), "ZZ", "F9", "Outro", "Nova")], "Id long, Fim timestamp, Tag string, Frota string, Tipo string, Classe string")
    got = encoding.transform(new, coder).first()
    assert got["Tag_freq"] == 0.0
    assert got["Classe_target_enc"] == pytest.approx(0.25)
    assert not got["Frota_F0"] and not got["Tipo_Caminhao"] and "Frota_F9" not in got.asDict()


def test_out_of_fold_starts_at_zero_and_uses_earlier_blocks_only(spark):
    rows = encoding.out_of_fold_target(cycles_frame(spark, 103)).orderBy("Fim").collect()
    assert rows[0]["Classe_target_enc"] == 0.0
    sizes = [sum(r["block"] == b for r in rows) for b in range(1, 6)]
    assert sizes == [21, 21, 21, 20, 20]
    b2 = next(r for r in rows if r["block"] == 2 and r["Classe"] == "Parado")
    first = [r for r in rows if r["block"] == 1 and r["Classe"] == "Parado"]
    assert b2["Classe_target_enc"] == pytest.approx(sum(r["target_4h"] for r in first) / len(first))


def test_perfect_ranking(spark):
    rows = frame(spark, list(zip([0, 1, 1, 0], [0.1, 0.9, 0.8, 0.2], [0.5] * 4, strict=True)), "target_4h int, score double, threshold double")
    at = metrics.binary_metrics(rows).first()
    rank = metrics.ranking_metrics(rows).first()
    assert (at["precision"], at["recall"], rank["auc_pr"], rank["auc_roc"]) == (1.0, 1.0, 1.0, 1.0)


def test_calibrated_thresholds(spark):
    flat = frame(spark, [(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], "target_4h int, score double")
    got = metrics.calibrated_threshold(flat, 0.99).first()
    assert got["target_met"] and got["degenerate"] and got["alert_rate"] == 1.0
    clear = frame(spark, [(0, 0.1), (1, 0.9), (1, 0.8), (0, 0.2)], "target_4h int, score double")
    got = metrics.calibrated_threshold(clear, 1.0).first()
    assert got["target_met"] and not got["degenerate"] and got["alert_rate"] < 1


def test_scores_that_are_no_numbers_predict_nothing(spark):
    rows = frame(spark, [(1, float("nan")), (1, None), (1, 0.9)], "target_4h int, s double")
    scored = scorecard.scored_frame(rows, F.col("s"), 0.5)
    assert [r["prediction"] for r in scored.collect()] == [0, 0, 1]


def panel_rows(spark):
    rows = [(10 * d + t, ts("2026-02-01") + timedelta(days=d), f"T{t}", 1 - 0.1 * t, int(t < 2)) for d in range(3) for t in range(6)]
    return frame(spark, rows, "Id long, Fim timestamp, Tag string, score double, target_4h int")


def test_topk(spark):
    got = {r["top_k_tags_per_day"]: r for r in scorecard.topk_metrics(scorecard.tag_day_panel(panel_rows(spark)), ks=(2, 6)).collect()}
    assert (got[2]["selected_alerts"], got[2]["total_positives"], got[2]["precision_at_k"], got[2]["recall_at_k"]) == (6, 6, 1.0, 1.0)
    assert got[2]["lift_vs_random"] == pytest.approx(3.0) and got[6]["lift_vs_random"] == pytest.approx(1.0)


def test_cooldown_is_greedy(spark):
    hours = [0, 3, 5, 8, 9, 20]
    rows = frame(spark, [(i, "A", ts("2026-01-01") + timedelta(hours=h), 1) for i, h in enumerate(hours)], "Id long, Tag string, Fim timestamp, prediction int")
    assert sorted(r["Id"] for r in scorecard.cooldown_dedup(rows).collect()) == [0, 2, 4, 5]


def test_one_hot_decoding(spark):
    rows = frame(spark, [(True, False), (False, True), (False, False)], "Frota_A boolean, Frota_B boolean")
    assert [r["f"] for r in rows.select(scorecard.decode_one_hot(rows, "Frota").alias("f")).collect()] == ["A", "B", "desconhecido"]


def test_daily_priority(spark):
    day = ts("2026-03-01 10:00")
    rows = [(1, "A", day, 0.3, 0.0, "793-D", "Caminhao"), (2, "A", day, 0.9, 2.0, "793-D", "Caminhao"), (3, "B", day, 0.7, 0.0, "X", "Escavadeira"), (4, "C", day, 0.6, 0.0, "X", "Escavadeira")]
    scored = frame(spark, rows, "Id long, Tag string, Fim timestamp, score double, n_alertas_4h double, Frota string, Tipo string").withColumn("threshold", F.lit(0.5))
    got = ranking.daily_priority(scored, 2).orderBy("rank").collect()
    assert [(r["Tag"], r["rank"]) for r in got] == [("A", 1), ("B", 2)]
    assert got[0]["motivo_principal"] == ranking.REASONS["n4"] and got[0]["Frota"] == "793-D" and got[1]["Tipo"] == "Escavadeira"


@pytest.mark.parametrize(("change", "good"), [({}, True), ({"Tag": None}, False), ({"duracao_ciclo_min": -1.0}, False), ({"dias_desde_ultimo_alerta": 20159.0}, False)])
def test_batch_contract(spark, change, good):
    row = {"Tag": "A", "Fim": ts("2026-01-01"), "n_alertas_4h": 1.0, "duracao_ciclo_min": 5.0, "dias_desde_ultimo_alerta": 2.0} | change
    batch = frame(spark, [tuple(row.values())], "Tag string, Fim timestamp, n_alertas_4h double, duracao_ciclo_min double, dias_desde_ultimo_alerta double")
    if good:
        assert contract.validate_batch(batch).count() == 1
    else:
        with pytest.raises(ValueError):
            contract.validate_batch(batch)


def test_drift(spark):
    ref = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("d"), F.lit(3.0).alias("k"))
    table = drift.reference_profile(ref, ["x", "d", "k"])
    same = {r["feature"]: r for r in drift.feature_drift(ref, table).collect()}
    assert all(abs(r["psi"]) < 1e-9 for r in same.values())
    moved = {r["feature"]: r for r in drift.feature_drift(ref.select((F.col("x") + 90).alias("x"), F.lit(None).cast("double").alias("d")), table).collect()}
    assert moved["x"]["psi"] > 0.25 and moved["x"]["faixa"] == "significativo"
    assert moved["d"]["psi"] is None and moved["d"]["faixa"] == "indisponivel" and moved["k"]["faixa"] == "ausente_no_lote"


def test_gates(spark):
    folds = frame(spark, [(0.8, 0.8), (0.82, 0.81), (0.79, 0.8)], "test_top15_recall_at_k double, test_top15_precision_at_k double")
    assert governance.stability_gate(folds).first()["passed"]
    with pytest.raises(ValueError):
        governance.stability_gate(folds.limit(2))
    good = frame(spark, [(0.8, 0.9, 2.5)], "test_top15_precision_at_k double, test_top15_recall_at_k double, test_top15_lift_vs_random double")
    assert governance.promotion_gate(good).first()["veredito"]
    assert not governance.promotion_gate(good, degenerate=True).first()["veredito"]


def test_work_log(spark):
    log = frame(spark, [("k", "pendente", "a", "2026-01-01"), ("k", "concluido", "b", "2026-01-02")], "key string, status string, note string, updated_at string")
    assert serving.latest_actions(log).first()["note"] == "b"
    with pytest.raises(ValueError):
        serving.upserted(log, frame(spark, [("k", "??", "", "2026")], "key string, status string, note string, updated_at string"))


def test_pages(spark):
    got = serving.page(spark.range(5), [F.asc("id")], 2, 2).collect()
    assert [r["id"] for r in got] == [2, 3] and got[0]["total"] == 5
