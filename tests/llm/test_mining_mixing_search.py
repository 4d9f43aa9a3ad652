"""Collocations, mixing and ranked search against brute force, with nulls, ties, repeats, hot keys and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigia.llm import collocations, mixing, ranked_search
from vigia.llm.words import byte_kinds, cut_words

# --- words


def test_words_keep_to_their_texts_and_pieces():
    texts = pa.array(["Ab c", None, "", "d", "e. F\tg", "É x;y"], pa.string())
    words, owner, piece = cut_words(texts.slice(0), collocations.KINDS)
    assert words.to_pylist() == ["ab", "c", "d", "e", "f", "g", "É", "x", "y"] and owner.tolist() == [0, 0, 3, 4, 4, 4, 5, 5, 5]
    same = piece[1:] == piece[:-1]
    assert same.tolist() == [True, False, False, False, True, False, True, False]
    words, owner, _ = cut_words(texts.slice(3, 2), byte_kinds(b" .\t"))
    assert words.to_pylist() == ["d", "e", "f", "g"] and owner.tolist() == [0, 1, 1, 1]
    assert len(cut_words(pa.array([], pa.string()), collocations.KINDS)[0]) == 0


# --- collocations


def brute_phrases(rows, top, depth, least, pct):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= pct * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), a, x, y, n[lang], -s) for r, (s, _, p, a, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def random_texts(seed, n=120):
    draw = random.Random(seed)
    words = ["a", "B", "cc", "dé", "e", "Zwölf", "x" * 3_000, " nbsp", "7"]
    rows = [(draw.choice(["en", "de", None]), "".join(draw.choice(words[: draw.choice([3, 9])]) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(draw.randrange(30)))) for _ in range(n)]
    return [*rows, (None, None), ("en", ""), ("en", " ,. "), ("fr", "one word"), *rows[:20]]


def found_phrases(spark, rows, **options):
    df = spark.createDataFrame([(k, "clash", *r) for k, r in enumerate(rows)], "doc_id long, phrase string, lang string, text string")
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize(("depth", "heavy"), [(3, 1_000), (3, 1), (2, 1), (4, 1_000)])
def test_collocations_match_brute_force(spark, monkeypatch, depth, heavy):
    # With ``heavy`` 1 (eight with four partitions) the most frequent pairs are hot and are spread by their third word.
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    rows = random_texts(depth)
    assert found_phrases(spark, rows, top=40, depth=depth, least=3) == brute_phrases(rows, 40, depth, 3, 50)


def test_a_hot_pair_is_counted_over_its_routes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HEAVY", 1)
    rows = [("en", " ".join(f"hot pair w{k % 40}" for k in range(90))) for _ in range(12)]
    assert found_phrases(spark, rows, top=100, least=5) == brute_phrases(rows, 100, 3, 5, 50)


def test_collocations_of_nothing(spark):
    assert found_phrases(spark, []) == [] and found_phrases(spark, [(None, None), ("en", "one two")]) == []


@pytest.mark.parametrize("seed", range(4))
def test_quicksort_of_suffixes_counts_prefixes(seed):
    draw = np.random.default_rng(seed)
    words = draw.integers(0, 6, (500, 3)).astype(np.int32)
    words[draw.random(500) < 0.2, 2] = -1
    weights = draw.integers(1, 4, 500)
    for route in (None, (words[:, 0] * 7 + words[:, 1]) % 5):
        found = collocations.frequent_prefixes(words, weights, 30, route)
        for d in range(3):
            want = Counter()
            for row, w in zip(words.tolist(), weights.tolist(), strict=True):
                if row[d] >= 0:
                    want[tuple(row[: d + 1])] += w
            got = [(tuple(words[p, : d + 1].tolist()), int(n)) for p, n in zip(*found[d], strict=True)]
            # A route shares leading pairs, so counts of single words are whole without routes only.
            if d or route is None:
                assert len(got) == len(set(got)) and dict(got) == {k: v for k, v in want.items() if v >= 30}
    assert [len(x) for x, _ in collocations.frequent_prefixes(words[:0], weights[:0], 1)] == [0, 0, 0]


def test_equal_rows_add_up_for_any_width():
    small = np.array([[1, 2, -1], [1, 2, 3], [1, 2, -1]], np.int32)
    for rows in (small, np.where(small >= 0, small + 3_000_000, -1)):
        kinds, n = collocations.added_up(rows)
        assert sorted(zip(map(tuple, kinds.tolist()), n.tolist(), strict=True)) == sorted(Counter(map(tuple, rows.tolist())).items())


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def mixed(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, size string").repartition(parts)
    return [r.asDict() for r in mixing.mix_sources(df).collect()]


def corpus(seed, n=240):
    draw = random.Random(seed)
    sources = ["a", "b", "\U0001f600", "￮", "tiny", None, "one"]
    rows = [(k, draw.choices(sources, [60, 20, 8, 8, 1, 5, 1])[0], "w " * draw.choice([0, 1, 1, 2, 5, 20, 80, 400])) for k in range(n)]
    return [*rows, (None, "a", "x y z"), (None, "a", "x y z"), rows[0], (n + 1, "none", None), (n + 2, "none", "  ")]


@pytest.mark.parametrize("seed", [0, 1])
def test_mixing_meets_its_targets(spark, seed):
    rows = corpus(seed)
    got = mixed(spark, rows)
    assert Counter((r["key"], r["size"]) for r in got) == Counter((k, len((t or "").split())) for k, _, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, source = brute_targets(sizes), {k: s for k, s, _ in rows}
    for s in sizes:
        mine = [r for r in got if source[r["key"]] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in mine)
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mine)
        known = [r for r in mine if r["size"]]
        if not known:
            assert want[s] == 0
            continue
        # What the rates make, what the copies make, and the form of the tilt.
        assert sum(r["rate"] * r["size"] for r in known) == pytest.approx(want[s], rel=2e-6, abs=0.6)
        capped = want[s] >= 3 * sizes[s]
        assert abs(sum(r["taken"] for r in known) - want[s]) <= (1e-6 if capped else 0.5 * min(r["size"] for r in known) + 1 if len({r["size"] for r in known}) > 3 else max(r["size"] for r in known))
        tilts = [math.log(r["rate"]) / r["size"] for r in known if 0 < r["rate"] < 3]
        assert not tilts or max(tilts) - min(tilts) < 1e-9
    assert sorted(map(str, mixed(spark, rows, 7))) == sorted(map(str, got))


def test_mixing_of_few_and_no_sources(spark):
    assert mixed(spark, []) == []
    assert [r["taken"] for r in mixed(spark, [(1, "s", "a b c"), (2, "s", "d")])] in ([3, 1], [1, 3])
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixed(spark, [(1, "s", ""), (2, None, None)]))


# --- ranked search


def brute_ranking(documents, queries, top=20):
    def terms(text):
        return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    docs = [(k, Counter(t), len(t)) for k, text in documents if (t := terms(text))]
    n, length = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in queries:
        scores = []
        for k, tf, size in docs:
            m = 100 - 25 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scores.append((-s, k is None, k, k))
        out += [(item, r, k, -s) for r, (s, _, _, k) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def search_corpus(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Und", "ÜBER", "é", "7", "the"]
    text = lambda n: "".join(draw.choices(words, [60 - k for k in range(60)] + [9] * 5)[0] + draw.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(k, text(draw.choice([1, 5, 40, 300]))) for k in range(150)]
    docs += [(1_000, None), (1_001, ""), (1_002, "?!"), (None, "w0 w1"), (1_003, docs[3][1]), (1_004, docs[3][1]), docs[3], (1_005, "w5 " * 5_000)]
    return docs, [(k, text(draw.choice([1, 4, 25]))) for k in range(12)] + [(50, None), (51, "..."), (52, "unknown words"), (3, "w5 w5 w5 the"), (53, docs[3][1])]


@pytest.mark.parametrize("seed", [0, 1])
def test_ranked_search_matches_brute_force(spark, seed):
    documents, queries = search_corpus(seed)
    docs = spark.createDataFrame([(k, "clash", t) for k, t in documents], "doc_id long, score string, text string").repartition(5)
    asked = spark.createDataFrame([(k, "clash", t) for k, t in queries], "item_id int, norm string, text string")
    for top in (20, 3):
        got = sorted(map(tuple, ranked_search.ranked_search(docs, asked, top).collect()), key=str)
        assert got == brute_ranking(documents, queries, top)


def test_large_query_sets_are_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "CELLS", 60)
    monkeypatch.setattr(ranked_search, "MAX_TERMS", 30)
    documents, queries = search_corpus(2)
    docs, asked = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(queries[:8], "item_id int, text string")
    assert sorted(map(tuple, ranked_search.ranked_search(docs, asked, 4).collect()), key=str) == brute_ranking(documents, queries[:8], 4)
    assert list(ranked_search.query_blocks([{1: 1}, {2: 1}, dict.fromkeys(range(70), 1), {}])) == [(0, 2), (2, 3), (3, 4)]


def test_ranked_search_of_nothing_and_other_keys(spark):
    docs, asked = spark.createDataFrame([("d", "a b"), ("c", "b a")], "doc_id string, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    find = lambda d, q: [tuple(r)[:3] for r in ranked_search.ranked_search(d, q).collect()]
    assert find(docs, asked) == [("q", 1, "c"), ("q", 2, "d")] or not ranked_search.ranked_search(docs, asked).count()
    assert find(docs.limit(0), asked) == find(docs, asked.limit(0)) == find(docs.withColumn("text", F.lit(None).cast("string")), asked) == []


@pytest.mark.parametrize("seed", range(3))
def test_bounds_leave_out_no_document(seed):
    draw = np.random.default_rng(seed)
    terms, top = 40, 5
    impact = np.where(draw.random((400, terms)) < 0.2, draw.integers(1, 10**6, (400, terms)), 0)
    impact = impact[np.argsort(-np.sqrt((impact.astype(float) ** 2).sum(1)))]
    rows = [{int(t): int(w) for t, w in zip(draw.choice(terms, 6, replace=False), draw.integers(1, 12_000, 6), strict=True)} for _ in range(9)]
    queries, ranking, scored = ranked_search.Queries(rows), ranked_search.Ranking(9, top, np.zeros(9)), 0
    for start in range(0, 400, 16):
        part = impact[start : start + 16]
        owner, term = np.nonzero(part)
        scored += ranked_search.scan_bucket(queries, ranking, list(range(start, start + len(part))), owner, term, part[owner, term], np.sqrt((part.astype(float) ** 2).sum(1)))
    for q, row in enumerate(rows):
        scores = sorted(((-sum(w * int(d[t]) for t, w in row.items()), k) for k, d in enumerate(impact)))
        assert ranking.best[q] == [(-s, k) for s, k in scores[:top] if s < 0]
    # Most pairs are left out unseen.
    assert scored < 0.5 * 9 * 400, scored
