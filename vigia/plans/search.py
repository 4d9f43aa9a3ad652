"""Model search: trials fitted side by side on features that are assembled once, and proposed from the results of earlier ones."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.operators import metrics, scorecard
from vigia.operators.ordered import written

#: Fits that run at a time; each fills what the others leave free of the cluster.
SIDE_BY_SIDE = 4
#: Trials drawn at random before the first that learns, numbers weighed for a proposal, and the share of earlier trials that count as good.
RANDOM_FIRST, CANDIDATES, GOOD = 8, 24, 0.25

#: Ranges of the parameters that trials are drawn from: low, high, whole numbers, by logarithm.
SPACES = {
    "logistic": {"C": (0.01, 10.0, False, True)},
    "gbt": {"maxIter": (40, 200, True, False), "maxDepth": (3, 6, True, False), "stepSize": (0.02, 0.2, False, True)},
    "forest": {"numTrees": (50, 300, True, False), "maxDepth": (4, 10, True, False)},
}


def side_by_side(spark: SparkSession, tasks: list[Callable[[], object]], at_a_time: int = SIDE_BY_SIDE) -> list:
    """The results of driver tasks in their order, a few at a time, each in a scheduling pool of its own (of use under fair scheduling)."""

    def run(numbered: tuple[int, Callable[[], object]]) -> object:
        k, task = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{k % at_a_time}")
        try:
            return task()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(at_a_time, len(tasks)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), list(enumerate(tasks))))


def search(data: DataFrame, features: list[str], trials: list[tuple[str, dict]], at_a_time: int = SIDE_BY_SIDE) -> DataFrame:
    """One row for each trial with its validation metrics; the test split isn't scored here."""
    rows = Assembled(data, features).metrics_of(list(enumerate(trials)), at_a_time)
    return _table(data.sparkSession, rows)


def adaptive_search(data: DataFrame, features: list[str], n: int, kinds: tuple[str, ...] = ("gbt", "forest", "logistic"), seed: int = 42, at_a_time: int = SIDE_BY_SIDE, spaces: dict = SPACES) -> tuple[DataFrame, list[tuple[str, dict]]]:
    """``n`` trials of each kind as by ``search``, and their parameters: the first ones at random, then rounds of proposals that learn from all before.

    A round has ``at_a_time`` trials, which don't see each other; the trials are the same for a seed.
    """
    ready, trials, rows = Assembled(data, features), [], []
    for number, kind in enumerate(kinds):
        mine: list[tuple[dict, float]] = []
        while len(mine) < n:
            size = min(n - len(mine), max(RANDOM_FIRST, at_a_time) if not mine else at_a_time)
            params = [propose(mine, spaces[kind], random.Random(f"{seed}:{number}:{len(mine)}:{k}")) for k in range(size)]
            found = ready.metrics_of([(len(trials) + k, (kind, p)) for k, p in enumerate(params)], at_a_time)
            trials += [(kind, p) for p in params]
            rows += found
            mine += [(p, _value(r)) for p, r in zip(params, found, strict=True)]
    return _table(data.sparkSession, rows), trials


def _value(row: tuple) -> float:
    """What proposals are judged by: recall, then precision, of the top fifteen, then average precision."""
    recall, precision, _, pr = (0.0 if x is None else x for x in row[2:6])
    return recall + 1e-3 * precision + 1e-6 * pr


def propose(earlier: list[tuple[dict, float]], space: dict, draw: random.Random) -> dict:
    """Parameters of the next trial of a kind, given earlier ones with their values (larger is better).

    Fewer than ``RANDOM_FIRST`` earlier trials: at random. Else numbers are drawn near the better part of the trials, and the one
    taken is where their density is highest against that of the others (a tree-structured Parzen estimator, parameter by parameter).
    """
    unit: dict[str, float] = {}
    if len(earlier) < RANDOM_FIRST:
        unit = {name: draw.random() for name in space}
    else:
        ranked = sorted(earlier, key=lambda x: -x[1])
        cut = max(2, round(GOOD * len(ranked)))
        for name, bounds in space.items():
            good, bad = (_kernels([_to_unit(p[name], bounds) for p, _ in part]) for part in (ranked[:cut], ranked[cut:]))
            near = [_drawn(good, draw) for _ in range(CANDIDATES)]
            unit[name] = max(near, key=lambda x: math.log(_density(x, good)) - math.log(_density(x, bad)))
    return {name: _from_unit(u, space[name]) for name, u in unit.items()}


def _kernels(points: list[float]) -> list[tuple[float, float]]:
    """A normal kernel at each point, as wide as the larger gap to its neighbours or the bounds, and a broad one in the middle."""
    at = sorted(points)
    ends = [0.0, *at, 1.0]
    least = 1 / (1 + min(100, len(at)))
    wide = [max(ends[k + 1] - ends[k], ends[k + 2] - ends[k + 1]) for k in range(len(at))]
    return [(0.5, 1.0), *((x, min(max(w, least), 1.0)) for x, w in zip(at, wide, strict=True))]


def _drawn(kernels: list[tuple[float, float]], draw: random.Random) -> float:
    """A number in [0, 1] from the mixture."""
    at, width = draw.choice(kernels)
    while not 0 <= (x := draw.gauss(at, width)) <= 1:
        pass
    return x


def _density(x: float, kernels: list[tuple[float, float]]) -> float:
    """The mixture's density on [0, 1], each kernel cut off at the bounds."""
    total = 0.0
    for at, width in kernels:
        inside = (math.erf((1 - at) / width / math.sqrt(2)) + math.erf(at / width / math.sqrt(2))) / 2
        total += math.exp(-0.5 * ((x - at) / width) ** 2) / (width * inside)
    return total / len(kernels)


def _to_unit(value: float, bounds: tuple) -> float:
    low, high, _, by_log = bounds
    return math.log(value / low) / math.log(high / low) if by_log else (value - low) / (high - low)


def _from_unit(u: float, bounds: tuple) -> float:
    low, high, whole, by_log = bounds
    value = low * (high / low) ** u if by_log else low + u * (high - low)
    return round(value) if whole else value


class Assembled:
    """Training and validation rows of a table with their features filled and assembled, written once for all trials."""

    def __init__(self, data: DataFrame, features: list[str]):
        from vigia.plans import ml

        train = ml.prepared(data.where("split = 'train'"), features)
        filled = Pipeline(stages=ml.preparation(features)).fit(train)
        self.spark = data.sparkSession
        self.train = written(filled.transform(train).select("label", "weight", "raw"), "search-train")
        self.rows = self.train.count()
        kept = [c for c in data.columns if c not in features]
        val = data.where("split = 'val'")
        # The features are cast for the model only; what the metrics read stays as it is.
        val = val.select(F.struct(*data.columns).alias("_row"), *[F.col(f).cast("int").cast("double").alias(f) if data.schema[f].dataType.typeName() == "boolean" else F.col(f).cast("double").alias(f) for f in features])
        self.val = written(filled.transform(val).select("_row.*", "raw").select(*kept, "raw"), "search-val")

    def metrics_of(self, trials: list[tuple[int, tuple[str, dict]]], at_a_time: int) -> list[tuple]:
        return side_by_side(self.spark, [lambda k=k, kind=kind, params=params: self._trial(k, kind, params) for k, (kind, params) in trials], at_a_time)

    def _trial(self, k: int, kind: str, params: dict) -> tuple:
        from vigia.plans import ml

        model = Pipeline(stages=ml.classifier(kind, self.rows, **params)).fit(self.train)
        scored = model.transform(self.val).withColumn("score", vector_to_array("probability")[1])
        scored = written(scored.drop("raw", "features", "rawPrediction", "probability", "prediction"), "search-scores")
        top = scorecard.topk_metrics(scorecard.tag_day_panel(scored), ks=(15,)).first()
        pr = metrics.ranking_metrics(scored).first()["auc_pr"]
        named = [None if top is None else top[c] for c in ("recall_at_k", "precision_at_k", "lift_vs_random")]
        return (k, f"{kind}_{k}", *named, pr, True)


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "trial int, model_name string, val_top15_recall_at_k double, val_top15_precision_at_k double, val_top15_lift_vs_random double, val_auc_pr double, eligible_for_selection boolean")
