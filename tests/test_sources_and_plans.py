"""Reading and writing, models, composite runs and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_operators import cycles_frame
from vigia.operators import labeling, scorecard
from vigia.plans import canonical, ml, pipelines
from vigia.sources import readers, sinks
from vigia.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_telemetry_folder(spark, tmp_path):
    rows = spark.createDataFrame([("X1", datetime(2026, 1, 1), "Overheat", 0, "Informacional"), ("X2", datetime(2026, 1, 2), "Other", 1, "Informacional")], "TAG string, Data_Evento timestamp, Alarme string, Is_Dont_Go int, Criticidade string")
    rows.write.parquet(str(tmp_path / "t" / "telemetry_jan.parquet"))
    rules = labeling.critical_rules(spark.createDataFrame([("ALARME OEM", "Overheat", "x", "Muito Alto")], "TIPO string, EVENTO string, SITUACAO string, NIVEL string"))
    telemetry = readers.read_table(spark, str(tmp_path / "t" / "telemetry_jan.parquet"))
    flagged = labeling.flag_events(labeling.prepare_events(telemetry), rules)
    assert labeling.critical_events(flagged).count() == 2


def test_cycles_prefer_parquet(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "apontamentos.csv").write_text("Id,Inicio,Fim,Tag,Frota,Tipo,Classe\n1,2026-01-01 00:00,2026-01-01 01:00,A,F,T,P\n")
    assert readers.find_cycles(spark, str(tmp_path / "raw")).count() == 1
    got = pipelines.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out")).first()
    assert got["Fim"] == datetime(2026, 1, 1, 4)


def test_partitioned_writes_replace_only_their_partition(spark, tmp_path):
    path = str(tmp_path / "scores")
    both = spark.createDataFrame([("a", 1), ("b", 2)], "batch_id string, x int")
    sinks.write_batch_scores(both, path)
    sinks.write_batch_scores(both.where("batch_id = 'a'").withColumn("x", F.lit(9)), path)
    assert {(r["batch_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_report_requires_fields(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(1.0,)], "precision double"), str(tmp_path / "r"))
    assert readers.read_report(spark, str(tmp_path / "r"), ["precision"]).count() == 1
    with pytest.raises(ValueError):
        readers.read_report(spark, str(tmp_path / "r"), ["recall"])


def modelled(spark):
    rows = cycles_frame(spark, 400).withColumns({"n_alertas_24h": (F.col("target_4h") * 3 + F.col("Id") % 2).cast("double"), "n_alertas_4h": F.col("target_4h").cast("double")})
    from vigia.operators.splits import temporal_split

    return temporal_split(rows)


def test_model_run_and_batches(spark, tmp_path):
    data, names = modelled(spark), ["n_alertas_24h", "n_alertas_4h"]
    found = pipelines.select_model(spark, data, names, [("logistic", {}), ("gbt", {"maxIter": 3})], str(tmp_path / "m"))
    assert found.where("split = 'test'").first()["auc_pr"] > 0.99
    model, manifest = sinks.read_model(spark, str(tmp_path / "m"))
    good = data.select("Id", "Tag", "Fim", *names).limit(20).withColumn("batch_id", F.lit("good"))
    bad = good.withColumns({"batch_id": F.lit("bad"), "Tag": F.lit(None).cast("string")})
    verdict = {r["batch_id"]: r["accepted"] for r in pipelines.score_batches(good.unionByName(bad), model, manifest, str(tmp_path / "b")).collect()}
    assert verdict == {"good": True, "bad": False}
    assert spark.read.parquet(str(tmp_path / "b" / "scores")).count() == 20
    assert spark.read.parquet(str(tmp_path / "b" / "rejected")).count() == 20


def test_calibration_keeps_the_order(spark):
    val = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.6, 1), (0.9, 1)], "score double, target_4h int")
    got = [r["score"] for r in ml.calibrate(val)(val).orderBy("target_4h").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    with pytest.raises(ValueError):
        ml.calibrate(val.where("target_4h = 1"))


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_stream_panel_equals_batch(spark, tmp_path):
    rows = canonical.scored(spark, SF).select("Id", "Tag", F.col("Fim").cast("timestamp").alias("Fim"), "score", "target_4h", "prediction")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drained(jobs.stream_tag_day_panel(stream).writeStream.outputMode("update").format("memory").queryName("panel").start())
    a = {tuple(r) for r in spark.table("panel").select("data", "Tag", "ciclos").collect()}
    b = {tuple(r) for r in scorecard.tag_day_panel(rows).select("data", "Tag", "ciclos").collect()}
    assert a == b


def test_stream_critical_events(spark, tmp_path):
    rows = canonical.telemetry(spark, SF).withColumn("Data_Evento", F.col("Data_Evento").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = labeling.critical_rules(canonical.rules(spark))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drained(jobs.stream_critical_events(stream, rules).writeStream.format("memory").queryName("critical").start())
    want = labeling.critical_events(labeling.flag_events(labeling.prepare_events(rows), rules)).count()
    assert spark.table("critical").count() == want


def test_stream_cooldown_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(i, "AB"[i % 2], start + timedelta(hours=i * 1.7), 1) for i in range(60)], "Id long, Tag string, Fim timestamp, prediction int")
    want = {r["Id"] for r in scorecard.cooldown_dedup(rows).collect()}
    last = spark.createDataFrame([(999, "Z", start + timedelta(days=30), 1)], rows.schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.stream_cooldown(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    assert {r["Id"] for r in spark.table("kept").collect()} - {999} == want


def test_drift_stream(spark, tmp_path):
    from vigia.operators.drift import reference_profile

    rows = spark.range(300).select((F.col("id") % 97).cast("double").alias("x"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = jobs.watch_drift(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), reference_profile(rows, ["x"]), str(tmp_path / "d"), str(tmp_path / "c"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "d")).first()["faixa"] == "estavel"
