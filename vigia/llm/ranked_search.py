"""Operator 13: ranked lexical search by norm buckets.

A document is a vector of impacts over the terms of the query set, a query a vector of term weights, a score their product.
Documents are dealt to ranges of their vectors' lengths and read from the longest on, in buckets. The best scores met so far
give each query a bound: a bucket is left out for a query when the product of both lengths can't reach it; inside a bucket
the query's largest coordinates give partial scores, and the lengths of what remains bound the rest. Survivors are scored
again in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vigia.llm.common import materialize, partitions, table, text_or_empty
from vigia.llm.words import blocks, byte_kinds, cut_words, one_array

#: Terms are runs of digits, letters and whatever isn't ASCII.
TERM_KINDS = byte_kinds(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Documents of one bucket; numbers in a bucket's and in a block of queries' matrix; terms of the queries that texts are read for at a time.
BUCKET, CELLS, MAX_TERMS = 512, 2_000_000, 200_000
#: Leading coordinates of a query hold all but this share of its length.
REST = 0.25
#: Documents of a range whose vectors are longest; their scores are the first bounds.
SEED = 2_048
#: Sums of doubles may be off by this share; bounds are widened by it.
SLACK = 1e-9


def query_terms(queries: DataFrame, key: str, text: str) -> list[tuple[int, object, dict[str, int]]]:
    """Number, key and counts of terms of each query that has any. The query set comes to the driver, which states it."""
    rows = queries.select(F.col(key).alias("key"), F.col(text).alias("text")).collect()
    found = []
    for k, row in enumerate(sorted(rows, key=lambda r: (r["key"] is None, r["key"], r["text"] or ""))):
        words, _, _ = cut_words(pa.array([row["text"]], pa.string()), TERM_KINDS)
        counted = words.value_counts().to_pylist()
        if counted:
            found.append((k, row["key"], {c["values"]: c["counts"] for c in counted}))
    return found


def term_counts(documents: DataFrame, terms: list[str], text: str, key: str) -> DataFrame:
    """``key, n, terms, tfs`` of each document with a term: its terms with repeats, and places and counts of those listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(terms, pa.large_string())
        for block in blocks(batches, 1):
            words, owner, _ = cut_words(one_array(block.column(1)), TERM_KINDS)
            coded = words.dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, listed), -1).to_numpy(zero_copy_only=False)
            term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
            n = np.bincount(owner, minlength=block.num_rows)
            pair, tf = np.unique(owner[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
            ends = np.r_[0, np.searchsorted(pair, np.arange(1, block.num_rows + 1) * len(terms))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pair % max(len(terms), 1)).astype(np.int32), tf.astype(np.int64))]
            made = pa.Table.from_arrays([block.column(0), pa.array(n.astype(np.int64)), *lists], names=["key", "n", "terms", "tfs"])
            yield from made.filter(pa.array(n > 0)).to_batches(max_chunksize=4_096)

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(count, f"key {kind}, n long, terms array<int>, tfs array<long>")


def impacts(counted: DataFrame, documents: int, length: int) -> DataFrame:
    """``key, terms, impacts, norm``: whole-number impacts of the listed terms, which length normalisation bounds, and their length."""
    m = (F.lit(100 - 25) + F.expr(f"(25 * n * {documents}L) div {length}L")).alias("m")
    with_m = counted.where(F.size("terms") > 0).select("key", "terms", "tfs", m)
    made = with_m.select("key", "terms", F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 12L * m))").alias("impacts"))
    square = F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return made.withColumn("norm", F.sqrt(square))


class Queries:
    """The weight vectors of a block of queries over the terms that they have, split into leading coordinates and the rest."""

    def __init__(self, rows: list[dict[int, int]]):
        self.terms = np.array(sorted({t for row in rows for t in row}), np.int64)
        self.weights = np.zeros((len(rows), len(self.terms)))
        self.lead = np.zeros((len(rows), len(self.terms)), bool)
        for q, row in enumerate(rows):
            if not row:  # no document has any of its terms
                continue
            at, w = np.searchsorted(self.terms, np.array(list(row), np.int64)), np.array(list(row.values()), float)
            self.weights[q, at] = w
            order = np.argsort(-w, kind="stable")
            rest = np.sqrt(np.maximum((w**2).sum() - np.cumsum(w[order] ** 2), 0))
            few = 1 + int(np.argmax(rest <= REST * np.sqrt((w**2).sum())))
            self.lead[q, at[order[:few]]] = True
        self.length = np.sqrt((self.weights**2).sum(1))
        self.support = self.weights > 0

    def bucket_rows(self) -> int:
        return max(16, min(BUCKET, CELLS // max(1, len(self.terms))))


def query_blocks(rows: list[dict[int, int]]) -> Iterator[tuple[int, int]]:
    """First and last number (exclusive) of blocks whose matrices of queries and terms stay small."""
    start, terms = 0, set()
    for k, row in enumerate(rows):
        if k > start and (k + 1 - start) * len(terms | row.keys()) > CELLS:
            yield start, k
            start, terms = k, set()
        terms |= row.keys()
    if rows:
        yield start, len(rows)


class Ranking:
    """The best documents of each query so far, by score and then by key; ``floor`` is what a document must reach."""

    def __init__(self, queries: int, top: int, floor: np.ndarray):
        self.top, self.floor = top, floor.astype(np.float64).copy()
        self.best: list[list[tuple[int, object]]] = [[] for _ in range(queries)]

    def add(self, q: int, keys: list, scores: np.ndarray) -> None:
        rows = self.best[q] + [(s, k) for s, k in zip(scores.tolist(), keys, strict=True) if s > 0 and s >= self.floor[q]]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        self.best[q] = rows[: self.top]
        if len(self.best[q]) == self.top:
            self.floor[q] = max(self.floor[q], self.best[q][-1][0])


def scan_bucket(queries: Queries, ranking: Ranking, keys: list, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, norms: np.ndarray) -> int:
    """Rank a bucket's documents (coordinates ``owner, term, impact``, sorted); returns how many pairs were scored exactly."""
    wide = 1 + SLACK
    live = np.flatnonzero(queries.length * norms.max() * wide >= np.maximum(ranking.floor, 1))
    if not len(live):
        return 0
    # Only terms of the block that occur in the bucket count.
    column = np.minimum(np.searchsorted(queries.terms, term), len(queries.terms) - 1)
    mine = queries.terms[column] == term
    used, inner = np.unique(column[mine], return_inverse=True)
    x = np.zeros((len(keys), len(used)))
    x[owner[mine], inner] = impact[mine]
    lead, weights = queries.lead[np.ix_(live, used)], queries.weights[np.ix_(live, used)]
    tail = queries.support[np.ix_(live, used)] & ~lead
    partial = x @ np.where(lead, weights, 0).T
    remaining = np.sqrt((x * x) @ tail.T.astype(float))
    own_rest = np.sqrt((np.where(lead, 0, weights) ** 2).sum(1))
    bound = (partial + remaining * own_rest) * wide
    rows, which = np.nonzero(bound >= np.maximum(ranking.floor[live], 1))
    whole = x.astype(np.int64)  # survivors are scored in whole numbers
    for j in np.unique(which).tolist():
        some, q = rows[which == j], int(live[j])
        on = np.flatnonzero(weights[j])
        scores = whole[np.ix_(some, on)] @ weights[j, on].astype(np.int64)
        ranking.add(q, [keys[i] for i in some.tolist()], scores)
    return len(rows)


def _ranked(batches: Iterator[pa.RecordBatch], queries: Queries, floors: np.ndarray, top: int, limit: int | None = None) -> Ranking:
    """Rank the documents of a partition, the longest vectors first."""
    ranking, seen = Ranking(len(queries.length), top, floors), 0
    for batch in batches:
        size = queries.bucket_rows()
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            terms, values = part.column(1), part.column(2)
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            scan_bucket(queries, ranking, part.column(0).to_pylist(), np.repeat(np.arange(len(sizes)), sizes), terms.flatten().to_numpy(), values.flatten().to_numpy(), part.column(3).to_numpy())
            seen += part.num_rows
            if limit and seen >= limit:
                return ranking
    return ranking


def rank_block(vectors: DataFrame, rows: list[dict[int, int]], top: int) -> DataFrame:
    """``query, key, score``: each range's best documents of each query of a block. ``vectors`` lies sorted in its files."""
    spark = vectors.sparkSession
    kind = vectors.schema["key"].dataType.simpleString()
    key_type = to_arrow_type(vectors.schema["key"].dataType)
    sent = spark.sparkContext.broadcast(rows)
    schema = f"query int, key {kind}, score long"

    def scanned(floors: list[float], limit: int | None):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranking = _ranked(batches, Queries(sent.value), np.array(floors), top, limit)
            found = [(q, k, s) for q, best in enumerate(ranking.best) for s, k in best]
            if found:
                q, k, s = zip(*found, strict=True)
                yield pa.record_batch([pa.array(q, pa.int32()), pa.array(k, key_type), pa.array(s, pa.int64())], names=["query", "key", "score"])

        return scan

    # First bounds: scores of the longest vectors. Any document's score bounds the best ones from below.
    head = vectors.orderBy(F.desc("norm"), "salt").limit(SEED).select("key", "terms", "impacts", "norm").coalesce(1)
    first = head.mapInArrow(scanned([0.0] * len(rows), SEED), schema).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= top)
    floors = [0.0] * len(rows)
    for row in first.collect():
        floors[row["query"]] = float(row["floor"])
    return vectors.select("key", "terms", "impacts", "norm").mapInArrow(scanned(floors, None), schema)


def ranked_search(documents: DataFrame, queries: DataFrame, top: int = 20, text: str = "text", key: str = "doc_id", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """The ``top`` documents of each query: ``query_key, rank, key, score``.

    Terms are maximal runs of digits, letters and other characters beyond ASCII, with A-Z in lower case. With ``N`` documents that
    have a term, ``L`` terms in them, ``df`` documents with the term, ``tf`` of it in a document of ``n`` terms: a term
    weighs ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))``, ``m = 75 + (25 n N) div L``, and a document scores the sum of
    ``w * ((1000000000 tf) div (1000 tf + 12 m))`` over the query's terms, repeats included. Documents of score 0 are left out;
    equal scores are ranked by ascending key, a null key last.

    Null and empty texts have no terms; a query without any has no rows; repeated documents are each ranked, queries that
    repeat a key too; empty tables give no rows; other columns are not looked at. Queries are a stated set: they come to the driver and
    are ranked in blocks, each against all documents. The result is exact: bounds only leave out what can't be among the best.
    """
    kind, query_kind = documents.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    parts = _searched(documents, query_terms(queries, query_key, query_text), top, text, key, query_kind)
    if not parts:
        return documents.sparkSession.createDataFrame([], f"`{query_key}` {query_kind}, rank int, `{key}` {kind}, score long")
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"name": query_key, "key": key})


def _searched(documents: DataFrame, asked: list, top: int, text: str, key: str, query_kind: str) -> list[DataFrame]:
    """``name, rank, key, score`` for blocks of queries; query sets of very many terms read the texts once for each half."""
    spark = documents.sparkSession
    terms = sorted({t for _, _, counts in asked for t in counts})
    if len(terms) > MAX_TERMS and len(asked) > 1:
        half = len(asked) // 2
        return [part for some in (asked[:half], asked[half:]) for part in _searched(documents, some, top, text, key, query_kind)]
    counted = materialize(term_counts(documents, terms, text, key), "search-terms")
    totals = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not asked or not totals["documents"]:
        return []
    # One count for each term of the queries.
    df = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    n = totals["documents"]
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(terms))]
    place = {t: k for k, t in enumerate(terms)}
    vectors = impacts(counted, n, totals["length"]).withColumn("salt", F.xxhash64("key", "terms"))
    ranged = vectors.repartitionByRange(partitions(spark), F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"), "salt")
    vectors = materialize(ranged, "search-vectors")
    rows = [{place[t]: c * weight[place[t]] for t, c in counts.items() if weight[place[t]] and place[t] in df} for _, _, counts in asked]
    out = []
    for start, end in query_blocks(rows):
        names = spark.createDataFrame([(q, k) for q, (_, k, _) in enumerate(asked[start:end])], f"query int, name {query_kind}")
        best = rank_block(vectors, rows[start:end], top)
        # At most ``top`` rows of each range for a query.
        ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key")))).where(F.col("rank") <= top)
        out.append(ranked.join(F.broadcast(names), "query").select("name", "rank", "key", "score"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts, row_number() OVER () AS d FROM documents),
u AS (SELECT d, doc_id, ts, len(ts) AS n FROM t WHERE len(ts) > 0),
z AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM u),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM u) GROUP BY d, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, z),
m AS (SELECT d, doc_id, 75 + (25 * n * nd) // l AS m FROM u, z),
s AS (SELECT item_id, m.d, m.doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY item_id, m.d, m.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
