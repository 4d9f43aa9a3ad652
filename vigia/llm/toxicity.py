"""Operator 7: toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import materialize, small_batches, table, text_or_empty

#: Labelled rows that the chain is fitted on at most, taken by a hash of the id.
MAX_TRAINING_ROWS = 20_000
FOLDS = 3
#: Words and word beginnings kept as features: those that tell toxic from other texts best.
FEATURES = 256
MIN_TEXTS = 4
PREFIXES = (3, 4, 5, 6)
MEMO_WORDS = 400_000
THRESHOLD = 0.5
EDGES = string.punctuation + "“”„«»¿¡…–—"
#: Kinds of toxic texts that are told apart; the categories are these and then the general one.
KINDS = 2
CATEGORIES = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]


def word_features(word: str) -> list[str]:
    """A word without the punctuation around it, in lower case, and its beginnings."""
    word = word.strip(EDGES).lower()
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)] if word else []


@dataclass
class Chain:
    """Linear models in the order of the categories; each sees the probabilities of those before it.

    ``weights[k]`` has one weight for each feature and then one for each earlier category.
    """

    categories: list[str]
    features: list[str] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Of rows of feature counts; without a fitted model all are 0."""
        out = np.zeros((len(counts), len(self.categories)))
        x = np.log1p(counts)
        for k, (w, b) in enumerate(zip(self.weights, self.intercepts, strict=True)):
            w = np.array(w)
            out[:, k] = 1 / (1 + np.exp(-np.clip(x @ w[: x.shape[1]] + out[:, :k] @ w[x.shape[1] :] + b, -700, 700)))
        return out


class _Places(dict):
    """Positions of a word's features, remembered up to a bound."""

    def __init__(self, features: list[str]):
        self.place = {f: k for k, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = tuple(self.place[f] for f in word_features(word) if f in self.place)
        return found


def feature_counts(texts: list[str], places: _Places) -> np.ndarray:
    out = np.zeros((len(texts), len(places.place)), np.float64)
    for row, text in zip(out, texts, strict=True):
        for found in filter(None, map(places.__getitem__, text.split())):
            for k in found:
                row[k] += 1
    return out


def training_rows(documents: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """``text, toxic, fold`` of at most ``MAX_TRAINING_ROWS`` labelled keys; a key labelled twice is toxic if it ever is."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taken = known.orderBy(F.xxhash64(key), key).limit(MAX_TRAINING_ROWS)
    rows = documents.select(F.col(key), text_or_empty(text).alias("text")).join(F.broadcast(taken), key)
    return rows.select("text", "toxic", F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("fold"))


def with_kinds(data: DataFrame) -> DataFrame:
    """``x, fold`` and one 0/1 column for each of ``CATEGORIES``, of feature rows ``x, fold, toxic``.

    The labels say toxic or not; the kinds are clusters of the toxic training rows by their features, the larger
    cluster first. They are made of training rows only, so their number is bounded.
    """
    scaled = Normalizer(inputCol="features", outputCol="unit").transform(data.withColumn("features", array_to_vector("x")))
    toxic = scaled.where("toxic = 1")
    if toxic.select("x").distinct().limit(KINDS).count() < KINDS:
        placed = scaled.withColumn("place", F.lit(0))
    else:
        model = KMeans(k=KINDS, featuresCol="unit", predictionCol="kind", seed=1, maxIter=20).fit(toxic.select("unit"))
        order = [r["kind"] for r in model.transform(toxic).groupBy("kind").count().orderBy(F.desc("count"), "kind").collect()]
        placed = model.transform(scaled).withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("kind")).cast("int") - 1)
    kinds = [((F.col("toxic") == 1) & (F.col("place") == k)).cast("int").alias(name) for k, name in enumerate(CATEGORIES[:-1])]
    return placed.select("x", "fold", *kinds, "toxic")


def choose_features(rows: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features with the largest likelihood-ratio statistic against the toxic label, in a fixed order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        memo: dict[str, list[str]] = {}

        def flush() -> pa.RecordBatch:
            names = list({*found[0], *found[1]})
            columns = [pa.array(names), *(pa.array([c[f] for f in names], pa.int64()) for c in found)]
            for c in found:
                c.clear()
            memo.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

        for batch in small_batches(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features: set[str] = set()
                for word in set(text.split()):
                    if word not in memo:
                        memo[word] = word_features(word)
                    features.update(memo[word])
                found[toxic > 0].update(features)
            if len(memo) > MEMO_WORDS:
                yield flush()
        yield flush()

    counted = rows.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    both = counted.where(F.col("c") + F.col("t") >= MIN_TEXTS)
    share = (F.col("c") + F.col("t")) / F.lit(n_toxic + n_clean)
    term = lambda seen, of: F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)
    cells = [(F.col("t"), n_toxic * share), (F.col("c"), n_clean * share), (n_toxic - F.col("t"), n_toxic * (1 - share)), (n_clean - F.col("c"), n_clean * (1 - share))]
    statistic = sum((term(a.cast("double"), b) for a, b in cells), F.lit(0.0))
    # Of signs of toxicity only: what is more frequent in toxic texts.
    signs = both.where(F.col("t") * n_clean > F.col("c") * n_toxic)
    return [r[0] for r in signs.orderBy(F.round(statistic, 6).desc(), "feature").limit(FEATURES).select("feature").collect()]


def fit_chain(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Chain:
    """Fit the categories in order, the general ``toxic`` last.

    With one class only there is nothing to learn; then nothing is toxic. Labels without a key, a value or a text are
    left out; null texts count as empty; of rows that repeat a key each text is a training row.
    """
    rows = materialize(training_rows(documents, labels, text, key), "toxicity-training")
    n_toxic, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_toxic or n_toxic == n:
        return Chain(CATEGORIES)
    features = choose_features(rows, n_toxic, n - n_toxic)
    if not features:
        return Chain(CATEGORIES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(features)
        for batch in small_batches(batches):
            x = np.log1p(feature_counts(batch.column(0).to_pylist(), places))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "fold", "toxic"])

    found = materialize(rows.select("text", "fold", "toxic").mapInArrow(count, "x array<double>, fold int, toxic int"), "toxicity-features")
    return fit_models(materialize(with_kinds(found), "toxicity-kinds"), features)


def fit_models(data: DataFrame, features: list[str]) -> Chain:
    """The chain for rows ``x, fold`` with a 0/1 column for each category.

    Later models are trained with out-of-fold probabilities of the earlier ones, so they learn how far these
    can be trusted on texts not seen.
    """
    chain = Chain(CATEGORIES, features)
    for k, category in enumerate(CATEGORIES):
        usable = data.select("fold", F.col(category).alias("label"), "x", array_to_vector("x").alias("features"), *CATEGORIES)
        model = _fit(usable)
        chain.weights.append(model[0])
        chain.intercepts.append(model[1])
        if k + 1 < len(CATEGORIES):
            parts = []
            for fold in range(FOLDS):
                w, b = _fit(usable.where(F.col("fold") != fold))
                z = F.aggregate(F.zip_with("x", F.array(*map(F.lit, w)), lambda a, c: a * c), F.lit(float(b)), lambda a, c: a + c)
                p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))
                parts.append(usable.where(F.col("fold") == fold).select(F.array_append("x", p).alias("x"), "fold", *CATEGORIES))
            data = materialize(_union(parts), "toxicity-features")
    return chain


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fit(rows: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept of a ridge logistic regression; of one class only, that class for sure."""
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        width = len(rows.select("x").first()[0]) if low is not None else 0
        return [0.0] * width, 30.0 if high else -30.0
    model = LogisticRegression(maxIter=40, regParam=1e-3, labelCol="label", featuresCol="features", standardization=False).fit(rows.select("label", "features"))
    return list(map(float, model.coefficients.toArray())), float(model.intercept)


def toxicity_scores(documents: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, a probability for each category (``p_<name>``) and ``toxic``, one row for each row.

    Null counts as empty; rows without a key and repeated rows each keep a row; an empty table gives none. There is no
    shuffle; the model that is sent has at most ``FEATURES`` features.
    """
    sent = documents.sparkSession.sparkContext.broadcast(chain)
    kind = documents.schema[key].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        places = _Places(model.features)
        for batch in small_batches(batches):
            p = model.probabilities(feature_counts(batch.column(1).to_pylist(), places))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=[key, *names, "toxic"])

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return documents.select(key, text_or_empty(text).alias("text")).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity_scores(documents, fit_chain(documents, table(spark, sf_dir, "labels")))


