"""Model operators on Spark ML: candidates, search, evaluation, backtest, calibration, importance, ablation, inference."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigia.functions.scalar import clip
from vigia.operators import contract, encoding, metrics, ranking, scorecard, splits
from vigia.operators.governance import compare, same_rows
from vigia.operators.ordered import placed
from vigia.plans.search import SIDE_BY_SIDE, SPACES, propose, side_by_side

TARGET = "target_4h"


def heuristic_score(df: DataFrame):
    """Alerts of the last 24 hours over 24, in [0, 1]."""
    return clip(F.coalesce(F.col("n_alertas_24h").cast("double"), F.lit(0.0)) / 24, 0.0, 1.0)


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles (booleans as 0 and 1), the label, and weights that balance the classes."""
    rate = df.agg(F.avg(F.col(TARGET).cast("double"))).first()[0] or 0.0
    ratio = (1 - rate) / rate if 0 < rate < 1 else 1.0
    casts = {f: F.col(f).cast("int").cast("double") if df.schema[f].dataType.typeName() == "boolean" else F.col(f).cast("double") for f in features}
    return df.withColumns({**casts, "label": F.col(TARGET).cast("double"), "weight": F.when(F.col(TARGET) == 1, F.lit(float(ratio))).otherwise(1.0)})


def preparation(features: list[str]) -> list:
    """Median imputation and assembly of the features as ``raw``."""
    filled = [f"_{f}" for f in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep")]


def classifier(kind: str, rows: int, **params: float) -> list:
    """A balanced classifier of ``raw``: ``logistic`` (scaled), ``gbt`` or ``forest``."""
    common = {"labelCol": "label", "weightCol": "weight"}
    if kind == "logistic":
        model = LogisticRegression(maxIter=int(params.get("maxIter", 50)), regParam=1 / (params.get("C", 0.5) * max(rows, 1)), featuresCol="features", **common)
        return [StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
    depth = int(params.get("maxDepth", 4))
    if kind == "gbt":
        return [GBTClassifier(maxIter=int(params.get("maxIter", 10)), maxDepth=depth, stepSize=params.get("stepSize", 0.1), seed=42, featuresCol="raw", **common)]
    if kind == "forest":
        return [RandomForestClassifier(numTrees=int(params.get("numTrees", 20)), maxDepth=depth, seed=42, featuresCol="raw", **common)]
    raise ValueError(f"unknown kind of model: {kind}")


def pipeline(kind: str, features: list[str], rows: int, **params: float) -> Pipeline:
    """Median imputation, assembly and a balanced classifier: ``logistic``, ``gbt`` or ``forest``."""
    return Pipeline(stages=[*preparation(features), *classifier(kind, rows, **params)])


def fit(train: DataFrame, features: list[str], kind: str = "logistic", **params: float) -> PipelineModel:
    rows = prepared(train, features)
    return pipeline(kind, features, rows.count(), **params).fit(rows)


def score(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with ``score``, the probability of the positive class; their own columns stay as they are."""
    out = model.transform(df.select("*", F.struct(*df.columns).alias("_row")).withColumns({f: F.col(f).cast("int").cast("double") if df.schema[f].dataType.typeName() == "boolean" else F.col(f).cast("double") for f in features}))
    return out.select("_row.*", vector_to_array("probability")[1].alias("score"))


def evaluate(scored: DataFrame, min_recall: float = 0.80) -> tuple[DataFrame, float]:
    """Metrics of each split at the threshold chosen on validation alone."""
    threshold = metrics.calibrated_threshold(scored.where("split = 'val'"), min_recall).first()["threshold"]
    at = metrics.binary_metrics(scored.where("split is not null"), ["split"], F.lit(threshold))
    rank = metrics.ranking_metrics(scored.where("split is not null"), ["split"])
    panel = scorecard.tag_day_panel(scored.where("split is not null"), ["split"])
    top = scorecard.topk_metrics(panel, ["split"]).where("top_k_tags_per_day = 15").select("split", "precision_at_k", "recall_at_k", F.col("lift_vs_random").alias("lift_at_k"))
    return at.join(rank, "split").join(top, "split"), threshold


def calibrate(val: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Isotonic calibration of scores, fitted on validation, where both classes must occur."""
    if val.select(TARGET).distinct().count() < 2:
        raise ValueError("calibration needs both classes")
    model = IsotonicRegression(labelCol="label", featuresCol="score", predictionCol="_p").fit(val.select(F.col(TARGET).cast("double").alias("label"), "score"))
    return lambda df: model.transform(df).withColumn("score", clip(F.col("_p"), 0.0, 1.0)).drop("_p")


def backtest(data: DataFrame, kind: str = "logistic", at_a_time: int = SIDE_BY_SIDE, **params: float) -> DataFrame:
    """For each fold: fit encoder, model and calibration, and score the fold's test part; the folds run side by side."""
    folds = splits.backtest_folds(data)

    def one(k: int) -> DataFrame:
        rows = folds.where(F.col("fold") == k)
        train, val, test = (rows.where(F.col("split") == s).drop("fold") for s in ("train", "val", "test"))
        coder = encoding.fit_encoder(train)
        coded = encoded_train(train, coder)
        features = modelled_columns(coded)
        model = fit(coded, features, kind, **params)
        adjust = calibrate(score(model, encoding.transform(val, coder), features))
        return adjust(score(model, encoding.transform(test, coder), features)).withColumn("fold", F.lit(k))

    names = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    scored = side_by_side(data.sparkSession, [lambda k=k: one(k) for k in names], at_a_time)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scored)
    panel = scorecard.tag_day_panel(out, ["fold"])
    return scorecard.topk_metrics(panel, ["fold"]).where("top_k_tags_per_day = 15").select("fold", F.col("precision_at_k").alias("test_top15_precision_at_k"), F.col("recall_at_k").alias("test_top15_recall_at_k"))


def importance(model: PipelineModel, data: DataFrame, features: list[str], repeats: int = 3, key: str = "Id") -> DataFrame:
    """``feature, importance``: the model's own, or the mean loss of average precision when a feature is permuted."""
    spark, last = data.sparkSession, model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
        return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")
    base = metrics.ranking_metrics(score(model, data, features)).select(F.col("auc_pr").alias("base"))
    found = metrics.ranking_metrics(score(model, permuted(data, features, repeats, key), features), ["_feature", "_repeat"])
    return found.join(F.broadcast(base)).groupBy(F.col("_feature").alias("feature")).agg(F.avg(F.col("base") - F.col("auc_pr")).alias("importance"))


def permuted(data: DataFrame, features: list[str], repeats: int = 3, key: str = "Id") -> DataFrame:
    """The rows once for each ``_feature`` and ``_repeat``, with the values of that feature permuted over the rows.

    Rows are placed in the order of their keys and in an order by hash for each repeat; the row at a place gets the value of
    the one that has the place in the other order. So each value goes to one row, nulls too, and a repeat's permutation is
    the same for all features. All variants are one table. Keys that repeat are placed by all their values.
    """
    whole = data.select("*", F.xxhash64(*[F.col(f"`{c}`") for c in data.columns]).alias("_hash"))
    rows = placed(whole, [key, "_hash"]).drop("_hash").withColumnRenamed("place", "_place")
    parts = []
    for r in range(repeats):
        mixed = placed(whole.select(F.xxhash64(F.lit(r), key, "_hash").alias("_mix"), "_hash", F.struct(*features).alias("_given")), ["_mix", "_hash"])
        parts.append(mixed.select(F.lit(r).alias("_repeat"), F.col("place").alias("_place"), "_given"))
    given = parts[0]
    for part in parts[1:]:
        given = given.unionByName(part)
    joined = rows.join(given, "_place").withColumn("_feature", F.explode(F.array(*map(F.lit, features))))
    return joined.withColumns({f: F.when(F.col("_feature") == f, F.col(f"_given.{f}")).otherwise(F.col(f)) for f in features}).drop("_given", "_place")


def leaky_encodings(data: DataFrame) -> DataFrame:
    """Encodings that see rows of all times: frequencies and categories of the whole table, and row-causal class means."""
    coded = encoding.transform(data, encoding.fit_encoder(data)).drop("Classe_target_enc")
    return encoding.expanding_target(coded)


def leakage_ablation(data: DataFrame, kind: str = "logistic", **params: float) -> DataFrame:
    """``metrica, base, novo, ganho``: encodings that see later rows and no embargo, against clean ones.

    The model and its parameters are the same, and so must be the test sets.
    """
    leaky = splits.temporal_split(leaky_encodings(data), embargo_hours=0.0, times=data)
    clean = splits.temporal_split(data)
    if not same_rows(leaky.where("split = 'test'"), clean.where("split = 'test'")):
        raise ValueError("the test sets of the two arms differ")
    train = clean.where("split = 'train'")
    coder = encoding.fit_encoder(train)
    arms = []
    for fit_rows, rows in ((leaky.where("split = 'train'"), leaky), (encoded_train(train, coder), encoding.transform(clean.where("split in ('val', 'test')"), coder))):
        names = modelled_columns(fit_rows)
        scored = score(fit(fit_rows, names, kind, **params), rows.where("split in ('val', 'test')"), names)
        arms.append(evaluate(scored)[0].where("split = 'test'"))
    return compare(arms[0], arms[1], ["precision_at_k", "recall_at_k", "lift_at_k", "auc_pr"])


def encoded_train(train: DataFrame, coder: dict[str, DataFrame]) -> DataFrame:
    """Training rows with the fitted encodings, but the class means out of fold."""
    return encoding.transform(encoding.out_of_fold_target(train).withColumnRenamed("Classe_target_enc", "_own"), coder).withColumn("Classe_target_enc", F.col("_own")).drop("_own", "block")


def modelled_columns(df: DataFrame) -> list[str]:
    return [f for f in contract.feature_columns(df) if f not in ("block", "score", "prediction", "threshold")]


def propose_trials(n: int, kinds: tuple[str, ...] = ("gbt", "forest", "logistic"), seed: int = 42, spaces: dict = SPACES) -> list[tuple[str, dict]]:
    """``n`` trials of each kind of model, the same ones for a seed."""
    draw, out = random.Random(seed), []
    for kind in kinds:
        out += [(kind, propose([], spaces[kind], draw)) for _ in range(n)]
    return out


def inference(batch: DataFrame, model: PipelineModel, features: list[str], threshold: float, encoder: dict[str, DataFrame] | None = None, top_k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Scores and the daily list of a batch: contract, encoding if needed, alignment, score, rank."""
    rows = contract.validate_batch(batch)
    rows = encoding.transform_if_needed(rows, encoder) if encoder else rows
    aligned = contract.align_features(rows, features)
    scored = scorecard.scored_frame(score(model, aligned, features), F.col("score"), threshold)
    return scored, ranking.daily_priority(scored, top_k)
