"""The composite runs: ingest, label, features, baseline, operations, segments, profile, batches, drift, selection."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from vigia.functions.scalar import shift_of
from vigia.operators import contract, drift, drift_parts, encoding, features, governance, labeling, metrics, profile, ranking, scorecard, splits
from vigia.operators.ordered import written
from vigia.plans import ml
from vigia.plans.search import search
from vigia.sources import readers, sinks
from vigia.streaming import jobs


def ingest(spark: SparkSession, folder: str, out: str, zone: str = "America/Sao_Paulo") -> DataFrame:
    """Find, check, normalize and write the cycles, and their quality report."""
    rows = contract.normalize_times(contract.require_columns(readers.find_cycles(spark, folder)), zone=zone)
    sinks.write_table(rows, f"{out}/cycles")
    kept = spark.read.parquet(f"{out}/cycles")
    sinks.write_report(contract.quality_report(kept), f"{out}/quality")
    return kept


def label(spark: SparkSession, cycles: DataFrame, telemetry_folder: str, rules_path: str, out: str) -> DataFrame:
    """Critical events by rule, then labels; events are written first, as the only reduction of the large table."""
    events, audit = readers.critical_events_from(spark, telemetry_folder, readers.read_rules(spark, rules_path))
    sinks.write_table(events, f"{out}/critical_events")
    sinks.write_report(audit, f"{out}/audit")
    sinks.write_table(labeling.label_cycles(cycles, spark.read.parquet(f"{out}/critical_events")), f"{out}/labeled")
    return spark.read.parquet(f"{out}/labeled")


def build_features(spark: SparkSession, out: str) -> DataFrame:
    rows = features.build_features(spark.read.parquet(f"{out}/labeled"), spark.read.parquet(f"{out}/critical_events"))
    sinks.write_table(rows, f"{out}/features")
    found = spark.read.parquet(f"{out}/features")
    sinks.write_report(features.null_profile(found, 10), f"{out}/feature_report")
    return found


def baseline(spark: SparkSession, data: DataFrame, out: str) -> DataFrame:
    """Split, encode (training rows out of fold, others by lookup), write, and score by the heuristic."""
    cut = splits.temporal_split(data)
    train, rest = cut.where("split = 'train'"), cut.where("split in ('val', 'test')")
    coder = encoding.fit_encoder(train)
    sinks.write_encoder(coder, f"{out}/encoder")
    coded = encoding.transform(train, coder).drop("Classe_target_enc").join(encoding.out_of_fold_target(train).select("Id", "Classe_target_enc"), "Id")
    sinks.write_partitioned(coded.unionByName(encoding.transform(rest, coder)), f"{out}/splits", "split")
    sinks.write_report(splits.split_metadata(cut), f"{out}/split_metadata")
    rows = spark.read.parquet(f"{out}/splits")
    scored = rows.withColumn("score", ml.heuristic_score(rows)).withColumn("model_name", F.lit("heuristica"))
    sinks.write_partitioned(scored, f"{out}/scores", "model_name", "split")
    return ml.evaluate(scored)[0]


def operations(scored: DataFrame, out: str) -> None:
    """Threshold, budget, top-K and cooldown tables of a scored table with splits."""
    known = scored.where("split is not null")
    sinks.write_csv(metrics.binary_metrics(known, ["split"]), f"{out}/threshold")
    sinks.write_csv(scorecard.budget_metrics(known), f"{out}/budgets")
    sinks.write_csv(scorecard.topk_metrics(scorecard.tag_day_panel(known, ["split"]), ["split"]), f"{out}/topk")
    sinks.write_report(scorecard.dedup_summary(known), f"{out}/dedup")
    sinks.write_csv(scorecard.extreme_false_negatives(known), f"{out}/extreme_fn")


def segments(scored: DataFrame, out: str) -> None:
    rows = scorecard.with_segments(scored)
    top = scorecard.topk_by_segment(rows)
    sinks.write_csv(scorecard.threshold_by_segment(rows), f"{out}/segment_threshold")
    sinks.write_csv(top, f"{out}/segment_topk")
    sinks.write_csv(scorecard.tag_hotspots(rows), f"{out}/hotspots")
    sinks.write_csv(scorecard.weakest_and_strongest(top), f"{out}/segment_lists")


def explore(labeled: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the exploratory report."""
    rows = features.calendar_features(labeled)
    return {
        "summary": profile.summary(rows),
        "target": profile.value_counts(rows, "target_4h"),
        "fleets": profile.value_counts(rows, "Frota", 15),
        "classes": profile.value_counts(rows, "Classe", 12),
        "hours": profile.hourly_counts(rows),
        "days": profile.moving_average(profile.daily_series(rows)),
        "weekday_hour": profile.weekday_hour_matrix(rows),
        "durations": profile.histogram(rows, "duracao_ciclo_min"),
        "lead_times": profile.histogram(rows, "tte_horas", 24, 0.0, 4.0),
        "boxes": profile.box_stats(rows),
        "rate_by_tag": profile.rate_by_category(rows, "Tag"),
        "rate_by_class": profile.rate_by_category(rows, "Classe"),
        "nulls": features.null_profile(rows, 15),
        "spearman": profile.spearman_pairs(rows, ["duracao_ciclo_min", "hora", "target_4h"]),
    }


def write_exploration(labeled: DataFrame, out: str, telemetry: DataFrame | None = None, rules: DataFrame | None = None) -> list[str]:
    """Write the exploratory tables, each to a CSV folder of its name, with those of alerts and rules where these are given; their names."""
    tables = explore(labeled)
    if telemetry is not None:
        tables |= {"alerts": profile.alert_profile(telemetry), "alert_period": profile.alert_period(telemetry), "alert_tags": profile.alert_tags(telemetry)}
    if rules is not None:
        tables["rules"] = profile.rule_profile(rules)
    for name, table in tables.items():
        sinks.write_csv(table, f"{out}/{name}")
    return sorted(tables)


def daily_batches(spark: SparkSession, folder: str, model_path: str, out: str, encoder_path: str | None = None, top_k: int = 15) -> DataFrame:
    """Score all pending batches in one job, archive their files, and write the log.

    Rows of batches that break the contract go to ``rejected``; files that can't be read are logged and archived as rejected, and stop no other.
    """
    model, manifest = sinks.read_model(spark, model_path)
    encoder = sinks.read_encoder(spark, encoder_path) if encoder_path else None
    verdict = judge_files(spark, folder, None, model, manifest, out, encoder, top_k)
    archived = sinks.archive(spark, folder, verdict, f"{out}/archive")
    log = verdict.join(F.broadcast(archived), "batch_id", "left")
    sinks.write_table(log, f"{out}/log")
    return spark.read.parquet(f"{out}/log")


def judge_files(spark: SparkSession, folder: str, names: list[str] | None, model, manifest: dict, out: str, encoder: dict[str, DataFrame] | None = None, top_k: int = 15) -> DataFrame:
    """The verdicts of ``score_batches`` on the files of a folder, with those that can't be read."""
    types = {"Tag": "string", "Fim": "timestamp", "Inicio": "timestamp", **dict.fromkeys(manifest["feature_columns"], "double")}
    rows, unreadable = readers.read_batches(spark, folder, types, names)
    lost = unreadable.select("batch_id", F.lit(0).cast("long").alias("rows"), F.lit(False).alias("accepted"), "motivo")
    if rows is None:
        return lost
    found = score_batches(rows, model, manifest, out, encoder, top_k)
    # A file with a header and no rows has no rows to judge.
    empty = set(names if names is not None else readers.list_batches(spark, folder)) - {r["batch_id"] for r in found.unionByName(lost).select("batch_id").toLocalIterator()}
    nothing = spark.createDataFrame([(n, 0, False, "sem linhas") for n in sorted(empty)], "batch_id string, rows long, accepted boolean, motivo string")
    return found.unionByName(lost).unionByName(nothing)


def score_batches(rows: DataFrame, model, manifest: dict, out: str, encoder: dict[str, DataFrame] | None = None, top_k: int = 15) -> DataFrame:
    """``batch_id, rows, accepted, motivo``; accepted batches go to ``scores`` and ``priority``, others to ``rejected``.

    Each batch has a partition of its own, so running it again replaces what it wrote before and nothing else.
    """
    broken = F.col("_broken")
    judged = rows.withColumn("_broken", contract.broken_rules(rows))
    reason = F.concat_ws(" ", F.get(broken, F.lit(0))["column"], F.get(broken, F.lit(0))["check"])
    verdict = judged.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), (~F.bool_or(F.size(broken) > 0)).alias("accepted"), F.min(F.when(F.size(broken) > 0, reason)).alias("motivo"))
    verdict = written(verdict, "verdict")
    side = lambda accepted: rows.join(verdict.where(F.col("accepted") == accepted).select("batch_id"), "batch_id", "left_semi")
    names = list(manifest["feature_columns"])
    good = encoding.transform_if_needed(side(True), encoder) if encoder else side(True)
    scored = scorecard.scored_frame(ml.score(model, contract.align_features(good, names), names), F.col("score"), float(manifest["threshold"]))
    sinks.write_batch_scores(scored, f"{out}/scores")
    if {"n_alertas_4h", "n_alertas_24h", "dias_desde_ultimo_alerta"} <= set(scored.columns):
        sinks.write_batch_scores(ranking.daily_priority(scored, top_k, ["batch_id"]), f"{out}/priority")
    sinks.write_batch_scores(side(False), f"{out}/rejected")
    return verdict


def watch_batches(spark: SparkSession, folder: str, model_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each drop of files is judged, scored and written as by ``daily_batches``, without archiving; the verdicts go to ``verdicts`` by batch.

    The stream is of file names only; each drop reads its files by itself, so that a bad one is rejected and the stream goes on.
    """
    model, manifest = sinks.read_model(spark, model_path)
    drops = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))

    def judge(df: DataFrame) -> None:
        names = [unquote(r["name"]) for r in df.collect()]
        wanted = [n for n in names if n in set(readers.list_batches(spark, folder))]
        if wanted:
            sinks.write_batch_scores(judge_files(spark, folder, wanted, model, manifest, out), f"{out}/verdicts")

    return jobs.score_drops(drops, judge, checkpoint)


def drift_baseline(reference: DataFrame, names: list[str], out: str, segments_: list[str] | None = None, period: str | None = None) -> DataFrame:
    """The profile of reference rows that have a ``prediction``: bins by feature, the alert rate, and the segments' categories.

    With ``period``, a column, the profile is made of stored parts: running it again with later rows adds their periods, replaces
    those that it has again, and leaves the others. Without, the rows are one period with exact bins.
    """
    spark = reference.sparkSession
    rows = reference.withColumn(drift_parts.PERIOD, F.col(period).cast("string") if period else F.lit("total"))
    if period:
        sinks.write_partitioned(drift_parts.feature_parts(rows, names), f"{out}/features", drift_parts.PERIOD)
        profile_table = drift_parts.profile_of(spark.read.parquet(f"{out}/features"))
    else:
        profile_table = drift.reference_profile(reference, names)
    sinks.write_partitioned(drift_parts.alert_parts(rows), f"{out}/alerts", drift_parts.PERIOD)
    if segments_:
        sinks.write_partitioned(drift_parts.category_parts(rows, segments_), f"{out}/categories", drift_parts.PERIOD)
    sinks.write_table(profile_table, f"{out}/profile")
    return spark.read.parquet(f"{out}/profile")


def drift_check(batch: DataFrame, baseline: str, out: str) -> DataFrame:
    """Compare a scored batch with a stored baseline; no row of the reference is read. Writes features, categories and the verdict."""
    spark = batch.sparkSession
    read = lambda name, schema: spark.read.schema(f"{schema}, {drift_parts.PERIOD} string").parquet(f"{baseline}/{name}")
    rate = drift_parts.alert_rate(read("alerts", "linhas long, alertas long"))
    try:
        known = drift_parts.categories_of(read("categories", "segmento string, categoria string, n long"))
    except AnalysisException:  # a baseline without segments
        known = spark.createDataFrame([], "segmento string, categoria string")
    watched = [r["segmento"] for r in known.select("segmento").distinct().collect() if r["segmento"] in batch.columns]
    found = drift.feature_drift(batch, spark.read.parquet(f"{baseline}/profile"))
    sinks.write_csv(found.orderBy(F.desc_nulls_last("psi"), "feature"), f"{out}/drift_features")
    changed = drift.category_drift(known.where(F.col("segmento").isin(watched)), drift.categories(batch, watched)) if watched else known.limit(0).withColumn("estado", F.lit(""))
    sinks.write_csv(changed, f"{out}/drift_categories")
    reasons = drift.retrain_reasons(found.where("feature <> 'score'"), found.where("feature = 'score'"), drift.alert_volume(rate or 0.0, batch), changed)
    sinks.write_report(reasons, f"{out}/drift")
    return reasons


def select_model(spark: SparkSession, data: DataFrame, names: list[str], trials: list[tuple[str, dict]], out: str, calibrated: bool = False, min_recall: float = 0.80) -> DataFrame:
    """Search, choose, refit and evaluate; returns the metrics of each split of the chosen model.

    Written are the trials, the scores of the best trial of each kind on all splits, the summary, the chosen model with
    its manifest, its threshold curve, importances, backtest, and a report. With ``calibrated``, scores are isotonic
    calibrations fitted on validation.
    """
    sinks.write_table(search(data, names, trials), f"{out}/trials")
    table = spark.read.parquet(f"{out}/trials")
    chosen = governance.select_model(table).first()
    known, fitted, rows = data.where("split is not null"), {}, []
    for kind in dict.fromkeys(k for k, _ in trials):
        best = governance.select_model(table.where(F.col("trial").isin([n for n, (k, _) in enumerate(trials) if k == kind]))).first()
        params = trials[best["trial"]][1]
        model = ml.fit(data.where("split = 'train'"), names, kind, **params)
        scored = ml.score(model, known, names)
        if calibrated:
            scored = ml.calibrate(scored.where("split = 'val'"))(scored)
        found, threshold = ml.evaluate(scored, min_recall)
        sinks.write_partitioned(scorecard.scored_frame(scored, F.col("score"), threshold).withColumn("model_name", F.lit(best["model_name"])), f"{out}/scores", "model_name", "split")
        rows.append(found.select(F.lit(best["model_name"]).alias("model_name"), F.lit(float(threshold)).alias("threshold"), "*"))
        fitted[best["model_name"]] = (model, float(threshold), kind, params)
    summary = rows[0]
    for r in rows[1:]:
        summary = summary.unionByName(r)
    sinks.write_table(summary, f"{out}/summary")
    name = chosen["model_name"]
    model, threshold, kind, params = fitted[name]
    scored = spark.read.parquet(f"{out}/scores").where(F.col("model_name") == name)
    sinks.write_csv(metrics.threshold_curve(scored.where("split = 'val'")), f"{out}/threshold_curve")
    sample = splits.repeatable_sample(known.where("split = 'val'"), IMPORTANCE_ROWS)
    sinks.write_csv(ml.importance(model, sample, names), f"{out}/importance")
    folds = ml.backtest(data.drop("split"), kind, **params)
    sinks.write_table(folds, f"{out}/backtest")
    rule = ", ".join(governance.SELECTION)
    manifest = spark.createDataFrame([(name, threshold, names, rule, json.dumps(params, sort_keys=True), min_recall, calibrated)], "model_name string, threshold double, feature_columns array<string>, selection_rule string, params string, min_recall double, calibrated boolean")
    source = governance.fingerprint(data).select(F.col("rows").alias("data_rows"), F.col("digest").alias("data_digest"))
    manifest = governance.config_hash(manifest.join(F.broadcast(source)), ["model_name", "params", "feature_columns", "min_recall"])
    sinks.write_model(model, manifest, out)
    known_metrics = [m for m in ("test_top15_precision_at_k", "test_top15_recall_at_k") if m in folds.columns]
    spread = governance.fold_summary(spark.read.parquet(f"{out}/backtest"), known_metrics).agg(F.collect_list(F.struct("metrica", "media", "desvio")).alias("backtest"))
    test = spark.read.parquet(f"{out}/summary").where((F.col("model_name") == name) & (F.col("split") == "test"))
    sinks.write_report(manifest.join(F.broadcast(test.drop("model_name", "threshold", "split"))).join(F.broadcast(spread)), f"{out}/report")
    return spark.read.parquet(f"{out}/summary").where(F.col("model_name") == name).drop("model_name", "threshold")


#: Rows that permutation importances are measured on.
IMPORTANCE_ROWS = 5_000


def with_shift(df: DataFrame) -> DataFrame:
    return df.withColumn("turno", shift_of(F.hour("Fim")))
