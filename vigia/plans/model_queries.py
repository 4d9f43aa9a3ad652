"""Queries that fit models on the fleet tables; SQL can't express them, tests check what can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.operators import encoding, features, metrics, scorecard, splits
from vigia.operators.ordered import written
from vigia.plans import canonical as c
from vigia.plans import ml, pipelines
from vigia.plans.queries import query
from vigia.plans.search import search


def modelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Features of all cycles with their splits, written once for the passes of the fits, and the names of all that may be modelled."""
    rows = splits.temporal_split(features.build_features(c.labeled(spark, sf_dir), c.errors(spark, sf_dir)), times=c.cycles(spark, sf_dir))
    data = written(rows, "modelled")
    return data, ml.modelled_columns(data)


def _scored(data: DataFrame, names: list[str], kind: str, **params: float) -> DataFrame:
    data = data.where("split is not null")
    return ml.score(ml.fit(data.where("split = 'train'"), names, kind, **params), data, names)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(c.profiled(spark, sf_dir).select("Id", "Fim", "Inicio", "Tag", "Frota", "Tipo", "Classe", "Matricula_Operador_Hash", "target_4h", "duracao_ciclo_min", "hora_do_dia"), "raw")


#: Trees of the registered fits; ``ml.SPACES`` has the ranges of a search in production.
TREES = 20


@query("c20_heuristic_metrics", """SELECT sum(p / tp::DOUBLE * cp / cn) AS auc_pr, sum(p * ((tn - cn) - (tp - cp) + 0.5 * (n - p))) / (max(tp) * (max(tn) - max(tp)))::DOUBLE AS auc_roc FROM (SELECT s, count(*) AS n, sum(y) AS p, sum(count(*)) OVER (ORDER BY s DESC) AS cn, sum(sum(y)) OVER (ORDER BY s DESC) AS cp, sum(count(*)) OVER () AS tn, sum(sum(y)) OVER () AS tp
  FROM (SELECT l.target_4h AS y, least(count(e.EVENT_TIME) FILTER (epoch_us(l.Fim) - epoch_us(e.EVENT_TIME) <= 86400000000) / 24.0::DOUBLE, 1) AS s FROM labeled l LEFT JOIN errors e ON l.Tag = e.TAG AND e.EVENT_TIME < l.Fim GROUP BY l.Id, l.target_4h) GROUP BY 1)""", "", "auc_pr auc_roc")  # fmt: skip
def _(spark, sf):
    rows = features.alert_history(c.labeled(spark, sf), c.errors(spark, sf))
    return metrics.ranking_metrics(rows.withColumn("score", ml.heuristic_score(rows)))


@query("c14_decoded_segments", "SELECT Id, Frota, Tipo FROM cycles")
def _(spark, sf):
    rows = c.labeled(spark, sf)
    coded = encoding.transform(rows, encoding.fit_encoder(rows))
    return coded.select("Id", scorecard.decode_one_hot(coded, "Frota").alias("Frota"), scorecard.decode_one_hot(coded, "Tipo").alias("Tipo"))


@query("j1_j5_logistic_evaluation")
def _(spark, sf):
    return ml.evaluate(_scored(*modelled(spark, sf), "logistic"))[0]


@query("j2_boosted_trees_evaluation")
def _(spark, sf):
    return ml.evaluate(_scored(*modelled(spark, sf), "gbt", maxIter=TREES))[0]


@query("j3_search_trials")
def _(spark, sf):
    return search(*modelled(spark, sf), [("logistic", {"C": 0.5}), ("gbt", {"maxIter": TREES, "maxDepth": 3})])


@query("j6_backtest")
def _(spark, sf):
    return ml.backtest(_raw(spark, sf))


@query("j7_calibrated_error")
def _(spark, sf):
    scored = _scored(*modelled(spark, sf), "logistic")
    return metrics.calibration_error(ml.calibrate(scored.where("split = 'val'"))(scored.where("split = 'test'")))


@query("j8_importance")
def _(spark, sf):
    data, names = modelled(spark, sf)
    return ml.importance(ml.fit(data.where("split = 'train'"), names, "forest", numTrees=TREES), data, names)


@query("j8_permutation_importance")
def _(spark, sf):
    data, names = modelled(spark, sf)
    sample = splits.repeatable_sample(data.where("split = 'val'"), pipelines.IMPORTANCE_ROWS)
    return ml.importance(ml.fit(data.where("split = 'train'"), names, "logistic"), sample, names)


@query("j9_leakage_ablation")
def _(spark, sf):
    return ml.leakage_ablation(_raw(spark, sf))


@query("j11_inference")
def _(spark, sf):
    data, names = modelled(spark, sf)
    model = ml.fit(data.where("split = 'train'"), names, "logistic")
    return ml.inference(data.where("split = 'test'"), model, names, 0.5)[1]
