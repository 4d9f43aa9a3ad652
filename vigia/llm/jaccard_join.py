"""Operator 3: exact n-gram Jaccard join in a metric space.

The sets are a text's distinct n-word shingles, the metric is the Jaccard distance, the radius is ``1 - threshold``.

* **First level.** Documents as pivots can't part unrelated texts: their distance to all of them is 1. The pivots
  are single shingles, in one global order (rare before frequent, then by hash). A text's home cell is that of its
  first shingle; a text within the radius lacks at most ``floor((1 - threshold) * size)`` of its shingles, so a
  window of one more than that many cells around home is sure to meet it. The text is replicated to these cells.
* **Windows.** Two texts of a cell are compared only if pivots that are large sets allow it: by the triangle
  inequality, the parts of a partition of all shingles where one intersection is odd and the other even are no more than
  the symmetric difference. The universe as the only pivot gives the window on sizes.
* **Second level.** In a cell, the most central text is a document pivot: all others are verified against it
  first. Texts inside its ball are one class; whatever lies outside is joined again with the classes so far, round
  after round, and a last round compares all pairs of different classes that the windows leave.
* Links are verified on whole texts. No pair within the radius is lost.
* **Counts.** All links of a text lie in its class, so at the end each class is cut into blocks by size classes and hash,
  and whole sets are compared for all pairs of blocks that can link. Tasks send counts for each text, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import materialize, partitions, remove, small_batches, table, text_or_empty

N, NUMERATOR, DENOMINATOR = 5, 80, 100
#: A shingle that more distinct sets than this have in their windows is frequent; frequent ones come last, by their counts.
FREQUENT = 8
#: Frequent shingles sent to the executors at most (8 bytes each); the order is exact with any of them left out.
MAX_FREQUENT = 2_000_000
#: Members of a cell that one task compares at once; larger cells are compared block by block.
CELL_BLOCK = 256
#: Sets of a block of a class when links are counted, and their shingles (8 bytes each), unless one set has more.
COUNT_BLOCK, COUNT_SHINGLES = 128, 250_000
#: Columns of the 0/1 matrices that are multiplied at once.
COUNT_COLUMNS = 8192
ROUNDS = 2
#: Sets that a task remembers to have sent already; sets beyond are merely sent again.
SEEN_SETS = 200_000
#: Groups of several blocks that are sent to all executors at most; with more, a shuffle joins them.
MAX_SENT_GROUPS = 500_000
#: Window entries of one bucket, on average.
BUCKET_ENTRIES = 300_000


_rng = np.random.default_rng(20_240_501)
#: A random 64-bit value for each byte, an odd base, and the base's inverse modulo 2 ** 64.
LETTERS = _rng.integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for texts of up to a million bytes."""
    if len(_powers[0]) < n:
        size = max(1 << 17, n)
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        if size > 1 << 20:
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


def shingle_set(text: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles.

    ASCII letters are lower-cased; words are runs of bytes other than ASCII white space. Fewer words than ``n``
    are one shingle; no words are none. A shingle is the bytes of its words with one space between; its hash is a
    difference of prefix sums of the bytes' random values times powers of the base.
    """
    data = np.frombuffer(b" ".join(text.lower().split()), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers_to(len(data))
    before = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers[: len(data)], out=before[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(data)]
    width = min(n, len(starts))
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    hashes = np.sort(_mixed((before[last] - before[first]) * inverses[first]))
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]]


def window_size(size: int) -> int:
    """Cells that a set of this size goes to."""
    return size - -(-NUMERATOR * size // DENOMINATOR) + 1


def _digests(shingles: np.ndarray) -> tuple[int, int]:
    """The two halves of a 128-bit digest of a set."""
    data = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def _entity(shingles: np.ndarray, clashes: dict[int, int]) -> int:
    """The number of a set: the first half of its digest, or the second one if another set has the same first half.

    ``clashes`` has the second half of the set that keeps the number, for each number that several sets have.
    """
    first, second = _digests(shingles)
    return second if clashes.get(first, second) != second else first


def pivot_parities(shingles: np.ndarray) -> bytes:
    """Whether the intersection with each part of a partition of all shingles is odd, as bits.

    The parts are a power of two, about four for each shingle, so few shingles of a difference share a part.
    """
    parts = 1 << min(16, max(7, (4 * len(shingles)).bit_length()))
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (parts - 1), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(parities: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of 64-bit words) of a partition with fewer parts, each a union of parts."""
    return np.bitwise_xor.reduce(parities.reshape(len(parities), -1, words), axis=1)


def may_link(a: np.ndarray, size_a: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the others (one row of parities each) the windows leave for ``a``: sizes, then the pivots' differences."""
    words = min(len(a), others.shape[1])
    near = DENOMINATOR * np.minimum(sizes, size_a) >= NUMERATOR * np.maximum(sizes, size_a)
    apart = np.bitwise_count(_folded(others, words) ^ _folded(a[None], words)).sum(axis=1, dtype=np.int64)
    # |A n B| / |A u B| >= t  means  |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|)
    return near & (apart * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * (sizes + size_a))


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def describe(documents: DataFrame) -> DataFrame:
    """``key, entity, second, size``: both halves of the digest of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingle_set(x) for x in batch.column(1).to_pylist()]
            halves = [_digests(s) if len(s) else (None, None) for s in sets]
            yield _batch(["key", "entity", "second", "size"], [batch.column(0), *(pa.array([h[k] for h in halves], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int64())])

    return documents.mapInArrow(run, "key long, entity long, second long, size long")


def told_apart(described: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``key, entity, size`` with a number of its own for each different set, and the clashes of ``_entity``.

    Clashes are different sets with one 64-bit number, of which even ten billion sets have only a few.
    """
    seen = described.where("entity is not null").groupBy("entity").agg(F.min("second").alias("kept"), F.max("second").alias("other"))
    clashes = {r["entity"]: r["kept"] for r in seen.where("kept < other").select("entity", "kept").collect()}
    entity = F.col("entity")
    if clashes:
        kept = F.create_map(*[F.lit(x).cast("long") for item in clashes.items() for x in item])[entity]
        entity = F.when(kept != F.col("second"), F.col("second")).otherwise(entity)
    return described.select("key", entity.alias("entity"), "size"), clashes


def cell_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
    return _batch(["mark", "chunk", "members"], [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)])


def _dealt(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Positions of the hashes of each bucket."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:]), strict=True))


def _repeated(values: np.ndarray, least: int) -> np.ndarray:
    distinct, counts = np.unique(values, return_counts=True)
    return distinct[counts >= least]


def frequent_shingles(documents: DataFrame, buckets: int, clashes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than ``FREQUENT`` distinct sets have in their windows by hash order, and the logarithms of their counts.

    A task sends each set's window once however many rows have it, and each shingle once with its count.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = counts.clip(max=65535).astype("<u2")
            deals = _dealt(values, buckets)
            return _batch(["bucket", "hashes", "counts"], [pa.array([b for b, _ in deals], pa.int32()), pa.array([values[i].tobytes() for _, i in deals], pa.binary()), pa.array([counts[i].tobytes() for _, i in deals], pa.binary())])

        for batch in small_batches(batches):
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                if len(s) and (e := _entity(s, clashes)) not in seen:
                    if len(seen) < SEEN_SETS:
                        seen.add(e)
                    held.append(s[: window_size(len(s))])
                    n += len(held[-1])
            if n > 2_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for b, data, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, []).append((data, counts))
        for parts in held.values():
            found, at = np.unique(np.frombuffer(b"".join(p[0] for p in parts), np.uint64), return_inverse=True)
            counts = np.bincount(at, np.frombuffer(b"".join(p[1] for p in parts), "<u2")).astype(np.int64)
            most = counts > FREQUENT
            yield _batch(["shingle", "n"], [pa.array(found[most].astype(np.int64)), pa.array(counts[most])])

    sent = documents.mapInArrow(send, "bucket int, hashes binary, counts binary").repartition(buckets, "bucket")
    counted = materialize(sent.mapInArrow(count, "shingle long, n long"), "jaccard-frequent")
    # The most frequent ones if there are more than may be sent.
    top = (counted if counted.count() <= MAX_FREQUENT else counted.orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT)).toPandas()
    shingles = top["shingle"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.log2(top["n"].to_numpy(np.float64)[order]).astype(np.uint8)


def cells(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int, clashes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """``mark, chunk, members`` of each cell with two entities or more, once for each membership; and each entity's windows.

    A cell of many members has several chunks. The second table has ``entity, size, parities``, where ``parities`` are those of the intersections with the large pivots.
    """
    sent = documents.sparkSession.sparkContext.broadcast(frequent)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "shingles", "entities", "sizes", "parities"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        seen: set[int] = set()
        late, level = sent.value
        held: list[tuple[np.ndarray, int, int]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate([h for h, _, _ in held])
            lengths = [len(h) for h, _, _ in held]
            entity = np.repeat(np.array([e for _, e, _ in held], np.int64), lengths)
            size = np.repeat(np.array([s for _, _, s in held], np.uint32), lengths)
            # Within a bucket 32 bits tell shingles apart; two that meet by chance only make a pair to verify.
            rows = [(b, values[i].astype(np.uint32).tobytes(), entity[i].tobytes(), size[i].tobytes(), None) for b, i in _dealt(values, buckets)]
            return _batch(names, [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)])

        for batch in small_batches(batches):
            described = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                if not len(s) or (e := _entity(s, clashes)) in seen:
                    continue
                if len(seen) < SEEN_SETS:
                    seen.add(e)
                k = window_size(len(s))
                if len(late):
                    at = np.searchsorted(late, s).clip(max=len(late) - 1)
                    s_ordered = s[np.argsort(np.where(late[at] == s, level[at], 0), kind="stable")]
                else:
                    s_ordered = s
                held.append((s_ordered[:k], e, len(s)))
                n += k
                described.append((-1, None, np.int64(e).tobytes(), np.uint32(len(s)).tobytes(), pivot_parities(s)))
            if described:
                yield _batch(names, [pa.array(c, k) for c, k in zip(zip(*described, strict=True), kinds, strict=True)])
            if n > 1_000_000:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    rows = materialize(documents.mapInArrow(replicate, "bucket int, shingles binary, entities binary, sizes binary, parities binary"), "jaccard-cells", compression="lz4")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32)
            yield _batch(["entity", "size", "parities"], [pa.array(e), pa.array(s.astype(np.int64)), batch.column(2).cast(pa.binary())])

    known = rows.where("bucket = -1").select("entities", "sizes", "parities").mapInArrow(unfold, "entity long, size long, parities binary")
    entities = materialize(known.groupBy("entity").agg(F.first("size").alias("size"), F.first("parities").alias("parities")), "jaccard-entities")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for b, *parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.setdefault(b, []).append(parts)
        for parts in held.values():
            shingle = np.frombuffer(b"".join(p[0] for p in parts), np.uint32)
            entity = np.frombuffer(b"".join(p[1] for p in parts), np.int64)
            size = np.frombuffer(b"".join(p[2] for p in parts), np.uint32)
            order = np.lexsort((entity, size, shingle))
            shingle, entity, size = shingle[order], entity[order], size[order]
            first = np.r_[True, (shingle[1:] != shingle[:-1]) | (entity[1:] != entity[:-1])]
            shingle, entity, size = shingle[first], entity[first], size[first]
            starts = np.r_[0, np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, len(shingle)]
            seen_marks = set()
            out: list[tuple] = []
            for a, b in zip(starts[:-1][np.diff(starts) > 1], starts[1:][np.diff(starts) > 1], strict=True):
                mark = int.from_bytes(hashlib.blake2b(entity[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
                if mark in seen_marks:
                    continue
                seen_marks.add(mark)
                # Chunks in the order of sizes, so chunks too far apart in size need not meet.
                for k, i in enumerate(range(a, b, CELL_BLOCK)):
                    out.append((mark, k, entity[i : min(i + CELL_BLOCK, b)]))
                if len(out) > 2000:
                    yield cell_batch(out)
                    out = []
            if out:
                yield cell_batch(out)

    met = rows.where("bucket >= 0").select("bucket", "shingles", "entities", "sizes").repartition(buckets, "bucket").mapInArrow(gather, "mark long, chunk int, members array<long>")
    found = materialize(met.groupBy("mark", "chunk").agg(F.first("members").alias("members")), "jaccard-groups")
    remove(rows)
    return found, entities


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``entity, component`` for each node: the smallest node that it reaches, by min labels and pointer jumping."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-links")
    near = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = materialize(near.select(F.col("a").alias("entity"), F.least("a", "m").alias("component")), "jaccard-labels")
    while True:
        offered = both.join(labels.withColumnRenamed("entity", "b"), "b").groupBy("a").agg(F.min("component").alias("o"))
        step = labels.join(offered, F.col("entity") == F.col("a"), "left").select("entity", "component", F.least("component", "o").alias("next"))
        jump = labels.select(F.col("entity").alias("e"), F.col("component").alias("further"))
        jumped = step.join(jump, F.col("next") == F.col("e"), "left").select("entity", F.least("next", "further").alias("component"), (F.least("next", "further") < F.col("component")).alias("moved"))
        after = materialize(jumped, "jaccard-labels")
        moved = after.where("moved").limit(1).count()
        remove(labels)
        labels = after.select("entity", "component")
        if not moved:
            return nodes.join(labels, "entity", "left").select("entity", F.coalesce("component", "entity").alias("component"))


def _rows_that_may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``a, b, size_a, size_b, parities_a, parities_b`` the ``a, b`` that the windows leave."""
    for batch in small_batches(batches, 4096):
        a, b, m, n, x, y = (c.to_pylist() for c in batch.columns)
        keep = [bool(may_link(np.frombuffer(x[k], np.uint64), m[k], np.frombuffer(y[k], np.uint64)[None], np.array([n[k]]))[0]) for k in range(len(a))]
        mask = pa.array(keep, pa.bool_())
        yield _batch(["a", "b"], [batch.column(0).filter(mask), batch.column(1).filter(mask)])


def placed(found: DataFrame) -> DataFrame:
    """``mark, chunk, entity, central`` of all members of cells.

    ``central`` counts the others that a text meets in its cells: the text that copies were made from has most of
    their shingles and meets more of them than they meet each other, so it makes the best pivot.
    """
    sizes = found.groupBy("mark").agg((F.sum(F.size("members")) - 1).alias("others"))
    members = found.join(sizes, "mark").select("mark", "chunk", F.explode("members").alias("entity"), "others")
    central = members.groupBy("entity").agg(F.sum("others").alias("central"))
    return members.join(central, "entity").select("mark", "chunk", "entity", "central")


CELL = ["mark", "chunk"]


def of_cells(members: DataFrame, found: DataFrame, *measures) -> DataFrame:
    """The members with aggregates over all members of their cell.

    Members are aggregated on the map side first, and aggregates are joined to them by chunk, of a bounded size each,
    so a large cell is no heavier for any task.
    """
    return members.join(found.select(*CELL).join(members.groupBy("mark").agg(*measures), "mark"), CELL)


def star_pairs(members: DataFrame, found: DataFrame, entities: DataFrame, turn: int) -> DataFrame:
    """Pairs of a cell's document pivot with its members of other classes, as far as the windows leave them.

    ``members``: ``mark, chunk, entity, component, central``. On the first turn the pivot is the most central text, on the
    second the most central one outside the class of the first.
    """
    top, other = F.max(F.struct("central", "entity", "component")).alias("pivot"), F.col("component") != F.col("pivot.component")
    met = of_cells(members, found, top).where(other)
    if turn:
        met = of_cells(met.drop("pivot"), found, top).where(other)
    pairs = met.select(F.least("pivot.entity", "entity").alias("a"), F.greatest("pivot.entity", "entity").alias("b")).distinct()
    side = lambda x: entities.select(F.col("entity").alias(x), F.col("size").alias(f"size_{x}"), F.col("parities").alias(f"parities_{x}"))
    near = DENOMINATOR * F.least("size_a", "size_b") >= NUMERATOR * F.greatest("size_a", "size_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return both.select("a", "b", "size_a", "size_b", "parities_a", "parities_b").mapInArrow(_rows_that_may_link, "a long, b long")


def dealt_parts(rows: DataFrame, by: list[str], splits) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``part``, a hash of the entity into as many parts of a group as ``splits`` says; and ``by, splits``.

    Only groups of several parts are looked up, which are few, so a large group stays where its rows are.
    """
    numbers = materialize(rows.groupBy(*by).agg(splits.cast("int").alias("splits")), "jaccard-numbers")
    large = numbers.where("splits > 1")
    large = F.broadcast(large) if large.count() <= MAX_SENT_GROUPS else large
    part = F.pmod(F.xxhash64("entity"), F.coalesce("splits", F.lit(1))).cast("int").alias("part")
    return rows.join(large, by, "left").select(*rows.columns, part), numbers


def block_pairs(numbers: DataFrame, group: str) -> DataFrame:
    """Pairs of blocks of a group that may hold links, of the numbers alone: ``group, kind1, part1, kind2, part2``.

    Size classes are equal or neighbours. Either side is first in half of the pairs, so that no block is second in most
    of its pairs.
    """
    each = numbers.select(group, "kind", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"))
    names = lambda k: each.select(group, F.col("kind").alias(f"kind{k}"), F.col("part").alias(f"part{k}"))
    later = (F.col("kind1") == F.col("kind2")) & (F.col("part1") <= F.col("part2"))
    pairs = names(1).join(names(2), group).where(later | (F.col("kind1") + 1 == F.col("kind2")))
    turned = F.pmod(F.col("part1") + F.col("part2"), F.lit(2)) == 1
    sides = [F.when(turned, F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}")).alias(f"{c}{a}") for a, b in ((1, 2), (2, 1)) for c in ("kind", "part")]
    return pairs.select(group, *sides)


def met_blocks(pairs: DataFrame, listed: DataFrame, group: str) -> DataFrame:
    """``m1, m2, same``: the members of both blocks of each pair. ``listed``: ``group, kind, part, m``."""
    held = lambda k: listed.select(F.col(group), F.col("kind").alias(f"kind{k}"), F.col("part").alias(f"part{k}"), F.col("m").alias(f"m{k}"))
    both = pairs.join(held(1), [group, "kind1", "part1"]).join(held(2), [group, "kind2", "part2"])
    same = (F.col("kind1") == F.col("kind2")) & (F.col("part1") == F.col("part2"))
    return both.select("m1", "m2", same.alias("same"))


def rest_pairs(members: DataFrame, found: DataFrame, entities: DataFrame) -> DataFrame:
    """All pairs of different classes that share a cell, as far as the windows leave them.

    Most pairs share many cells with the same document pivot, so the cells of a pivot are joined to one region and its
    pairs are looked at once. A region is cut by size classes, of which only equal and neighbouring ones can link, and
    these by hash into blocks of a bounded size; pairs of blocks are made of their numbers and then dealt to tasks.
    """
    measures = [F.max(F.struct("central", "entity")).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")]
    region = of_cells(members, found, *measures).where("low < high").select(F.col("pivot.entity").alias("pivot"), "entity", "component").distinct().join(entities, "entity")
    kind = F.floor(F.log("size") / float(np.log(DENOMINATOR / NUMERATOR))).cast("int").alias("kind")
    region = materialize(region.select("pivot", "entity", "component", "size", "parities", kind), "jaccard-region")
    blocks, numbers = dealt_parts(region, ["pivot", "kind"], F.ceil(F.count(F.lit(1)) / CELL_BLOCK))
    listed = materialize(blocks.groupBy("pivot", "kind", "part").agg(F.collect_list(F.struct("entity", "size", "component", "parities")).alias("m")), "jaccard-listed")
    return met_blocks(block_pairs(numbers, "pivot"), listed, "pivot").mapInArrow(_pairs_of_chunks, "a long, b long").distinct()


def _pairs_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fields(members: list[dict]) -> list[tuple[np.ndarray, ...]]:
        """Entities, sizes, components and parities of the members, by the length of their parities."""
        by_length: dict[int, list[dict]] = {}
        for m in members:
            by_length.setdefault(len(m["parities"]), []).append(m)
        return [(*(np.array([m[k] for m in some], np.int64) for k in ("entity", "size", "component")), np.stack([np.frombuffer(m["parities"], np.uint64) for m in some])) for some in by_length.values()]

    for batch in small_batches(batches, 16):
        a: list[int] = []
        b: list[int] = []
        for m1, m2, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            left = fields(m1)
            right = left if same else fields(m2)
            for i, (ids, sizes, kinds, parities) in enumerate(left):
                for j, (ids2, sizes2, kinds2, parities2) in enumerate(right):
                    if same and j < i:
                        continue
                    for k in range(len(ids)):
                        start = k + 1 if same and i == j else 0
                        if start < len(ids2) and (other := kinds2[start:] != kinds[k]).any():
                            found = ids2[start:][other & may_link(parities[k], int(sizes[k]), parities2[start:], sizes2[start:])]
                            a += np.minimum(found, ids[k]).tolist()
                            b += np.maximum(found, ids[k]).tolist()
        yield _batch(["a", "b"], [pa.array(a, pa.int64()), pa.array(b, pa.int64())])


def verified(pairs: DataFrame, holders: DataFrame, documents: DataFrame, clashes: dict[int, int]) -> DataFrame:
    """``a, b`` of the pairs whose whole texts are within the radius. ``holders``: ``entity, key``, one document each."""
    key = lambda side: holders.select(F.col("entity").alias(side), F.col("key").alias(f"key_{side}"))
    named = pairs.join(key("a"), "a").join(key("b"), "b")
    text = lambda side: documents.select(F.col("key").alias(f"key_{side}"), F.col("text").alias(f"text_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in small_batches(batches):
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != x:
                    last = (x, shingle_set(x))
                other = shingle_set(y)
                if (_entity(last[1], clashes), _entity(other, clashes)) != (a, b):  # another text under the same key
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(DENOMINATOR * shared >= NUMERATOR * (len(last[1]) + len(other) - shared))
            mask = pa.array(keep, pa.bool_())
            yield _batch(["a", "b"], [batch.column(0).filter(mask), batch.column(1).filter(mask)])

    joined = named.join(text("a"), "key_a").join(text("b"), "key_b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one."""
    values = [np.concatenate(sets) for sets in (left, right)]
    common = np.intersect1d(*values)
    shared = np.zeros((len(left), len(right)), np.int64)
    places = []
    for sets, v in zip((left, right), values, strict=True):
        at = np.searchsorted(common, v).clip(max=max(0, len(common) - 1))
        known = common[at] == v if len(common) else np.zeros(len(v), bool)
        row, column = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[known], at[known]
        order = np.argsort(column, kind="stable")
        places.append((row[order], column[order]))
    for start in range(0, len(common), COUNT_COLUMNS):
        width = min(COUNT_COLUMNS, len(common) - start)
        ones = []
        for sets, (row, column) in zip((left, right), places, strict=True):
            a, b = np.searchsorted(column, (start, start + width))
            x = np.zeros((len(sets), width), np.float32)
            x[row[a:b], column[a:b] - start] = 1
            ones.append(x)
        shared += (ones[0] @ ones[1].T).astype(np.int64)
    return shared


def _links_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``m1, m2, same`` (lists of ``entity, n_rows, shingles``) the rows that each set's rows link with in the other block."""
    for batch in batches:
        for k in range(batch.num_rows):
            blocks = []
            for column in (0, 1):
                members = batch.column(column)[k].as_py()
                blocks.append((np.array([m["entity"] for m in members], np.int64), np.array([m["n_rows"] for m in members], np.int64), [np.frombuffer(m["shingles"], np.uint64) for m in members]))
            (ids1, rows1, sets1), (ids2, rows2, sets2) = blocks
            shared = _shared(sets1, sets2)
            sizes1, sizes2 = (np.array([len(x) for x in sets], np.int64) for sets in (sets1, sets2))
            linked = DENOMINATOR * shared >= NUMERATOR * (sizes1[:, None] + sizes2[None] - shared)
            if batch.column(2)[k].as_py():
                linked &= ids1[:, None] != ids2[None]
                ids, counts = ids1, linked @ rows2
            else:
                ids, counts = np.concatenate([ids1, ids2]), np.concatenate([linked @ rows2, linked.T @ rows1])
            yield _batch(["entity", "n"], [ids[counts > 0], counts[counts > 0]])


def link_counts(labels: DataFrame, links: DataFrame, holders: DataFrame, documents: DataFrame, clashes: dict[int, int]) -> DataFrame:
    """``entity, n``: the rows with other sets that each set of a class links with; sets without any may lack.

    ``labels``: ``entity, component``; ``links``: ``a, b``; ``holders``: ``entity, key, n_rows``. Pairs of blocks are made
    of the blocks' numbers, before the sets are joined to them.
    """
    linked = links.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    members = labels.join(linked, "entity", "left_semi").join(holders, "entity")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [shingle_set(x) for x in batch.column(3).to_pylist()]
            own = pa.array([_entity(s, clashes) == e for s, e in zip(found, batch.column(0).to_pylist(), strict=True)], pa.bool_())  # not another text under the same key
            columns = [*(batch.column(k) for k in range(3)), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
            yield _batch(["entity", "component", "n_rows", "size", "shingles"], [c.filter(own) for c in columns])

    texts = members.join(documents, "key").select("entity", "component", "n_rows", "text")
    found = texts.mapInArrow(sets, "entity long, component long, n_rows long, size long, shingles binary").dropDuplicates(["entity"])
    kind = F.floor(F.log("size") / float(np.log(DENOMINATOR / NUMERATOR))).cast("int").alias("kind")
    found = materialize(found.select("entity", "component", "n_rows", "size", "shingles", kind), "jaccard-sets", compression="lz4")
    blocks, numbers = dealt_parts(found, ["component", "kind"], F.ceil(F.greatest(F.count(F.lit(1)) / COUNT_BLOCK, F.sum("size") / COUNT_SHINGLES)))
    listed = materialize(blocks.groupBy("component", "kind", "part").agg(F.collect_list(F.struct("entity", "n_rows", "shingles")).alias("m")), "jaccard-blocks", compression="lz4")
    counted = met_blocks(block_pairs(numbers, "component"), listed, "component").mapInArrow(_links_of_blocks, "entity long, n long")
    out = materialize(counted.groupBy("entity").agg(F.sum("n").alias("n")), "jaccard-counts")
    for used in (found, numbers, listed):
        remove(used)
    return out


def jaccard_classes(documents: DataFrame, text: str = "text", key: str = "doc_id", counts: bool = True) -> DataFrame:
    """``key, n_shingles, component_id`` and, with ``counts``, ``n_links`` for each row.

    Two texts link when the Jaccard similarity of their sets is 0.8 or more. ``component_id`` is the smallest key
    reachable; ``n_links`` is the number of all other rows that the row's text links with, exact copies included. Texts
    without words, empty or null, have an empty set, link with nothing and are their own component. Rows with a null
    key are dropped from linking the same way: they keep a row with a null component, have no links and don't count
    as links of others. Repeated rows are equal sets, share a component and link. An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("key"), text_or_empty(text).cast("binary").alias("text"))
    described, clashes = told_apart(materialize(describe(rows), "jaccard-documents"))
    total = described.agg(F.sum("size")).first()[0] or 0
    buckets = max(8 * partitions(spark), total // 5 // BUCKET_ENTRIES)
    holders = materialize(described.where("entity is not null and key is not null").groupBy("entity").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n_rows")), "jaccard-holders")
    found, entities = cells(rows, frequent_shingles(rows, buckets, clashes), buckets, clashes)
    everywhere = materialize(placed(found), "jaccard-placed")
    nodes = entities.select("entity")
    links = tested = None
    labels = nodes.select("entity", F.col("entity").alias("component"))
    for turn in range(ROUNDS + 1):
        members = everywhere.join(labels, "entity")
        pairs = star_pairs(members, found, entities, turn) if turn < ROUNDS else rest_pairs(members, found, entities)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jaccard-pairs")
        new = materialize(verified(pairs, holders, rows, clashes), "jaccard-verified")
        links = new if links is None else links.unionByName(new)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if new.limit(1).count():
            labels = materialize(components(nodes, links), "jaccard-components")
    lowest = labels.join(holders, "entity").groupBy("component").agg(F.min("key").alias("component_id"))
    if not counts:
        named = materialize(labels.join(lowest, "component").select("entity", "component_id"), "jaccard-named")
        return described.join(named, "entity", "left").select("key", F.col("size").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
    degree = link_counts(labels, links, holders, rows, clashes)
    n_links = (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n_links")
    named = labels.join(lowest, "component").join(holders.select("entity", "n_rows"), "entity").join(degree, "entity", "left")
    named = materialize(named.select("entity", "component_id", n_links), "jaccard-named")
    return described.join(named, "entity", "left").select(
        "key",
        F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"),
        F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
