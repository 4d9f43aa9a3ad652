"""Operator 11: phrase collocations from suffix pointers, sorted by multikey three-way quicksort.

Every word of a text starts a suffix, of which the first words count. Tasks cut texts into words, add up equal suffixes
of a block of texts and route them by their two leading words, each block's share of a route as one row. A route's
suffixes are sorted by three-way partitions, word after word to the largest depth: the weight of an equal partition is the count
of its phrase, and any partition that weighs less than the least count is abandoned, as it can hold no candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.llm.common import materialize, partitions, table
from vigia.llm.words import blocks, byte_kinds, cut_words, one_array

KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words of a language that a route stands for, on average.
ROUTE_WORDS = 2_000_000
#: A leading pair is hot if it starts more than one of so many suffixes; there are no more hot pairs than that.
HEAVY = 1_000
#: Parts that a language's phrases are ranked in before the last ranking.
RANK_PARTS = 16


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC4CEB9FE1A85EC53)


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def suffixes(codes: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words at each place that a word follows in its piece; -1 beyond the piece's end."""
    out = np.full((len(codes), depth), -1, np.int32)
    out[:, 0] = codes
    for d in range(1, depth):
        same = piece[d:] == piece[:-d]
        out[:-d, d][same] = codes[d:][same]
    return out[out[:, 1] >= 0] if depth > 1 else out


def added_up(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of small whole numbers from -1, and how often each occurs."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    width = int(rows.max()) + 2
    if width ** rows.shape[1] < 1 << 63:
        key = np.zeros(len(rows), np.int64)
        for column in rows.T:
            key = key * width + (column + 1)
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
    else:
        order = np.lexsort(rows.T[::-1])
        first = np.flatnonzero(np.r_[True, (np.diff(rows[order], axis=0) != 0).any(1)])
    return rows[order[first]], np.diff(first, append=len(rows))


def frequent_prefixes(words: np.ndarray, weights: np.ndarray, least: int, route: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth a row that starts with each prefix which weighs ``least`` or more, and the prefix's weight.

    A multikey three-way quicksort of row pointers; all partitions of a round are parted at once. ``route`` starts with the
    rows dealt by a number that all rows with the same leading words share.
    """
    depth = words.shape[1]
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth)]
    pointer = np.arange(len(words))
    segment = np.zeros(len(words), np.int64)
    if route is not None:
        pointer = np.argsort(route.astype(np.uint16), kind="stable")
        segment = np.cumsum(np.diff(route[pointer].astype(np.int64), prepend=-1) != 0) - 1
    at = np.zeros(int(segment[-1]) + 1 if len(segment) else 0, np.int64)  # the depth that each segment is parted at
    while len(pointer):
        # Segments lie one after the other; light ones can't hold a heavy prefix.
        weight = np.bincount(segment, weights[pointer], len(at))
        live = weight >= least
        stay = live[segment]
        pointer, segment = pointer[stay], (np.cumsum(live) - 1)[segment[stay]]
        at = at[live]
        if not len(pointer):
            break
        size = np.bincount(segment, minlength=len(at))
        start = np.cumsum(size) - size
        value = words[pointer, at[segment]]
        low, middle, high = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[segment]
        side = (value > pivot).astype(np.int64) + (value >= pivot)
        # A stable three-way partition of all segments.
        group = 3 * segment + side
        counts = np.bincount(group, minlength=3 * len(at))
        base = np.cumsum(counts) - counts
        place = np.empty(len(group), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            own = counts.reshape(-1, 3)[:, s]
            place[mine] = base[group[mine]] + np.arange(len(mine)) - np.repeat(np.cumsum(own) - own, own)
        moved, parted = np.empty_like(pointer), np.empty_like(group)
        moved[place], parted[place] = pointer, group
        weight = np.bincount(parted, weights[moved], 3 * len(at))
        equal = np.arange(1, 3 * len(at), 3)
        heavy = equal[(weight[equal] >= least) & (counts[equal] > 0)]
        levels = at[heavy // 3]
        for d in np.unique(levels).tolist():
            some = heavy[levels == d]
            found[d].append((moved[base[some]], weight[some].astype(np.int64)))
        deeper = np.repeat(at, 3)
        deeper[equal] += 1
        # Equal partitions go on with the next word, without the rows that end here.
        stay = deeper[parted] < depth
        stay[stay] = words[moved[stay], deeper[parted[stay]]] >= 0
        pointer, at = moved[stay], deeper
        segment = parted[stay]
    none = np.zeros(0, np.int64)
    return [(np.concatenate([r for r, _ in x]), np.concatenate([w for _, w in x])) if x else (none, none) for x in found]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """Language, distinct words, numbers of the words in order, and pieces, of each block and language in it."""
    for block in blocks(batches, 1):
        languages = one_array(block.column(0))
        for language in languages.unique().to_pylist():
            texts = one_array(block.column(1)).filter(pa.compute.equal(languages, language))
            words, _, piece = cut_words(texts, KINDS)
            coded = words.dictionary_encode()
            yield language, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), piece


def _rows(language: str, phrases: list[str] | pa.Array, words: int, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.record_batch([pa.array([language] * n, pa.string()), pa.array(phrases).cast(pa.string()), pa.array(np.full(n, words, np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "words", "f"])


def word_counts(texts: DataFrame, heavy: int) -> DataFrame:
    """``lang, phrase, words, f`` of ``lang, text``: counts of single words, and those of pairs that are heavy in a block (their sums there).

    A pair with more than two of ``heavy`` suffixes has at least one of ``heavy`` in these sums.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, names, codes, piece in _by_language(batches):
            counts = np.bincount(codes, minlength=len(names))
            for start in range(0, len(names), 100_000):
                yield _rows(language, names[start : start + 100_000], 1, counts[start : start + 100_000])
            pairs, n = added_up(suffixes(codes, piece, 2))
            most = (n * heavy >= n.sum()) & (n > 1)
            chosen = names.take(pa.array(pairs[most].ravel())).to_pylist()
            yield _rows(language, [f"{a} {b}" for a, b in zip(chosen[::2], chosen[1::2], strict=True)], 2, n[most])

    local = texts.mapInArrow(count, "lang string, phrase string, words int, f long")
    return local.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def routed_suffixes(texts: DataFrame, routes: int, depth: int, hot: dict[str, list[int]]) -> DataFrame:
    """``lang, route, words, codes, counts``: a block's suffixes for each route.

    The two leading words give the route; those of hot pairs (by their hash) are routed by three words.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, names, codes, piece in _by_language(batches):
            rows, counts = added_up(suffixes(codes, piece, depth))
            to = _routing(rows, _hashes(names), hot.get(language, [])) % np.uint64(routes)
            order = np.argsort(to, kind="stable")
            rows, counts, to = rows[order], counts[order], to[order]
            ends = [*np.flatnonzero(np.diff(to)).tolist(), len(to) - 1] if len(to) else []
            start, made, size = 0, [], 0
            for end in ends:
                part = rows[start : end + 1]
                used, inner = np.unique(part, return_inverse=True)
                inner = inner.reshape(part.shape).astype(np.int32)
                if used[0] < 0:
                    used, inner = used[1:], inner - 1
                spelled = "\n".join(names.take(pa.array(used)).to_pylist()).encode()
                made.append((language, int(to[start]), spelled, inner.tobytes(), counts[start : end + 1].astype(np.int64).tobytes()))
                size += len(spelled) + 20 * len(part)
                start = end + 1
                if size > 8 << 20 or start > ends[-1]:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["lang", "route", "words", "codes", "counts"])
                    made, size = [], 0

    return texts.mapInArrow(route, "lang string, route long, words binary, codes binary, counts binary")


def _routing(rows: np.ndarray, hashes: np.ndarray, hot: list[int]) -> np.ndarray:
    """The hash of the leading words that a suffix goes by."""
    pair = _mixed(hashes[rows[:, 0]], hashes[rows[:, 1]])
    if not hot or rows.shape[1] < 3:
        return pair
    third = np.where(rows[:, 2] >= 0, hashes[rows[:, 2]], np.uint64(0))
    return np.where(np.isin(pair, np.array(hot, np.uint64)), _mixed(pair, third), pair)


def frequent_phrases(routed: DataFrame, depth: int, least: int, routes: int, hot: dict[str, list[int]]) -> DataFrame:
    """``lang, phrase, words, f``: phrases of two to ``depth`` words that occur ``least`` times or more.

    Parts of hot pairs' counts come from several routes and are added up.
    """

    def sort(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        language = key[0].as_py()
        spelled: list[str] = []
        codes, counts = [], []
        for words, inner, n in zip(*(group.column(c).to_pylist() for c in ("words", "codes", "counts")), strict=True):
            own = words.decode().split("\n")
            rows = np.frombuffer(inner, np.int32).reshape(-1, depth)
            codes.append(np.where(rows >= 0, rows + len(spelled), -1))
            spelled += own
            counts.append(np.frombuffer(n, np.int64))
        coded = pa.array(spelled, pa.large_string()).dictionary_encode()
        del spelled
        names, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        rows, weights = np.concatenate(codes), np.concatenate(counts)
        rows = np.where(rows >= 0, number[rows], -1).astype(np.int32)
        hashes, mine = _hashes(names), np.array(hot.get(language, []), np.uint64)
        found = frequent_prefixes(rows, weights, least, (_routing(rows, hashes, hot.get(language, [])) // np.uint64(routes)) & np.uint64(0xFFFF))
        pair = _mixed(hashes[rows[:, 0]], hashes[rows[:, 1]]) if len(mine) else None
        out = []
        for d in range(1, depth):
            first, n = found[d]
            if d == 1 and pair is not None:
                cold = ~np.isin(pair[first], mine)
                first, n = first[cold], n[cold]
                where = np.flatnonzero(np.isin(pair, mine))
                kinds, which = np.unique(rows[where, :2], axis=0, return_inverse=True)
                sums = np.bincount(which.ravel(), weights[where], len(kinds)).astype(np.int64)
                out.append(_rows(language, _spelled(names, kinds), 2, sums))
            out.append(_rows(language, _spelled(names, rows[first, : d + 1]), d + 1, n))
        return pa.Table.from_batches(out)

    counted = routed.groupBy("lang", "route").applyInArrow(sort, "lang string, phrase string, words int, f long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _spelled(names: pa.Array, rows: np.ndarray) -> pa.Array:
    """The words of each row, joined by spaces."""
    columns = [names.take(pa.array(rows[:, d])) for d in range(rows.shape[1])]
    return pa.compute.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))


def collocations(documents: DataFrame, top: int = 2_000, depth: int = 3, least: int = 10, covered_pct: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``depth`` words that occur ``least`` times or more.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line breaks into pieces and those at blanks into words. A phrase's
    score is the least of ``floor(1000000 a a / (l r))`` over its cuts, where ``a, l, r`` count the phrase and its two parts.
    Phrases inside a longer candidate with ``covered_pct`` per cent of their count or more are left out. Ties go to larger counts, then to the
    phrase's bytes. Columns: ``lang, rank, phrase, a, l, r, n, score``; ``n`` counts the language's words.

    Null texts are empty; a null language is ``und``; repeated rows count each; empty tables give no rows; other columns are not
    looked at. Counts are exact over all texts: candidates are told apart by their words, hashes only route them. No group is
    larger than a route: leading pairs that hold many suffixes are spread by their third word.
    """
    spark = documents.sparkSession
    texts = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    heavy = max(HEAVY, 2 * partitions(spark))
    counted = materialize(word_counts(texts, heavy), "collocation-words")
    totals = materialize(counted.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n")), "collocation-totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, list[int]] = {}
    for row in counted.where((F.col("words") == 2) & (F.col("f") * heavy >= n)).select("lang", "phrase").collect():
        pair = _hashes(pa.array(row["phrase"].split(" ")))
        hot.setdefault(row["lang"], []).append(int(_mixed(pair[:1], pair[1:])[0]))
    routes = max(partitions(spark), -(-n // ROUTE_WORDS))
    phrases = materialize(frequent_phrases(routed_suffixes(texts, routes, depth, hot), depth, least, routes, hot), "collocation-phrases")
    known = counted.where((F.col("words") == 1) & (F.col("f") >= least)).unionByName(phrases).select("lang", "phrase", "f")
    parts = lambda c: F.split(c, " ")
    joined = lambda words, start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", joined(parts("phrase"), F.lit(1), F.col("k")).alias("left"), joined(parts("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # Products of two counts stay below 38 digits: exact, or an error.
    cuts = cuts.withColumns({"up": (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "down": wide("l") * wide("r")})
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr("up div down").cast("long").alias("score"), "k", "l", "r")).alias("s"))
    inside = []
    for length in range(2, depth):
        starts = F.explode(F.sequence(F.lit(1), F.col("words") - length + 1)).alias("start")
        inside.append(phrases.where(F.col("words") > length).select("lang", "phrase", "f", starts).select("lang", joined(parts("phrase"), F.col("start"), F.lit(length)).alias("phrase"), "f"))
    if inside:
        longer = reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered_pct, F.lit(True)))
    flat = scored.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS piece, lang, w FROM (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t))),
g AS (SELECT lang, len, w[i : i + len - 1] AS ws FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(len))),
f AS (SELECT lang, len, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY lang, len, array_to_string(ws, ' ')),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, ws, f AS a FROM f WHERE len > 1 AND f >= 10),
k AS (SELECT c.*, k, array_to_string(ws[1 : k], ' ') AS lp, array_to_string(ws[k + 1 :], ' ') AS rp FROM c, (VALUES (1), (2)) v(k) WHERE k < len),
s AS (SELECT k.lang, k.phrase, k.len, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, array_to_string(ws[1 : 2], ' ') AS phrase FROM c WHERE len = 3 UNION ALL SELECT lang, a, array_to_string(ws[2 : 3], ' ') FROM c WHERE len = 3) GROUP BY lang, phrase),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.len = 2 WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a)
SELECT r.lang, rank, phrase, a, l, r.r AS r, n, score::BIGINT AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
