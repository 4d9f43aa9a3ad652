"""Operator 4: packing token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.llm.common import materialize, sized_batches, table, text_or_empty
from vigia.llm.tokenizer import Encoder, encoder_from_json, with_end

#: Bytes of text that a task encodes at once, of what its encoder remembers, and of an Arrow batch. An executor's Python workers and
#: its JVM, whose heap earlier stages have filled, share one limit.
SLICE_BYTES, MEMO_BYTES, BATCH_BYTES = 2 << 20, 64 << 20, 8 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Pieces that one population packs; a larger table has more such groups, each of about this size.
GROUP_PIECES = 4000
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 3, 3, 16, 6, 2
#: Items of a bin, and displaced ones, that a search for a better filling looks at.
SWAPS = 40
#: Bins of at least this fill are what crossover passes on, and what stays closed before the second round.
WELL_FILLED = 0.999
CLOSED = 0.97


def token_pieces(documents: DataFrame, tokenizer_path: str, length: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``length`` where it is longer; the first may be shorter.

    Columns: ``key, piece, start, length, ids_crc32``. Null counts as the empty text.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_batches(encoder_from_json(sent.value, MEMO_BYTES), batches, length, end_id)

    rows = documents.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long")


def cut_batches(encoder: Encoder, batches: Iterable[pa.RecordBatch], length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """The pieces of rows ``key, text``, a slice of ``SLICE_BYTES`` at a time: encoding builds many times the bytes of its texts."""
    pool = pa.default_memory_pool()
    for batch in sized_batches(batches, 1, SLICE_BYTES):
        ids, ends = with_end(*encoder.encode_array(batch.column(1)), end_id)
        sizes = np.diff(ends, prepend=0)
        # A longer text's first piece takes what is over.
        n_pieces = -(-sizes // length)
        row = np.repeat(np.arange(len(sizes)), n_pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        stop = sizes[row] - (n_pieces[row] - 1 - piece) * length
        start = np.maximum(stop - length, 0)
        first = (ends - sizes)[row]
        data = memoryview(ids).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((first + start).tolist(), (first + stop).tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(stop - start), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "ids_crc32"])
        pool.release_unused()


@contextmanager
def small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends Python batches of ``BATCH_BYTES``; then the session's setting holds again."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def best_fit(lengths: list[int], items: list[int], room: list[int], bins: list[list[int]], capacity: int) -> None:
    """Put the items, longest first, each into the fullest bin that still takes it; open bins as needed.

    ``open_at[r]`` lists bins with ``r`` left, and bit ``r`` of ``mask`` tells whether there are any.
    """
    open_at: dict[int, list[int]] = {}
    mask = 0
    for b, left in enumerate(room):
        if left:
            open_at.setdefault(left, []).append(b)
            mask |= 1 << left
    for item in sorted(items, key=lambda i: -lengths[i]):
        need = lengths[item]
        fitting = mask >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            b = open_at[left].pop()
            if not open_at[left]:
                mask ^= 1 << left
        else:
            b, left = len(bins), capacity
            bins.append([])
            room.append(capacity)
        bins[b].append(item)
        room[b] = left - need
        if room[b]:
            open_at.setdefault(room[b], []).append(b)
            mask |= 1 << room[b]


class Packing:
    """Bins of items, with the room left in each."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins or []
        self.room = [capacity - sum(lengths[i] for i in b) for b in self.bins]

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then more uneven filling, which leaves bins that can be emptied."""
        return -len(self.bins), sum((1 - r / self.capacity) ** 2 for r in self.room)

    def filled(self, items: list[int]) -> Packing:
        best_fit(self.lengths, items, self.room, self.bins, self.capacity)
        return self

    def without(self, gone: set[int]) -> tuple[list[list[int]], list[int]]:
        """Bins that have none of these items, and the other items of the bins that had."""
        keep, displaced = [], []
        for b in self.bins:
            if gone.isdisjoint(b):
                keep.append(b)
            else:
                displaced += [i for i in b if i not in gone]
        return keep, displaced

    def crossed(self, other: Packing, rng: np.random.Generator) -> Packing:
        """Whole well-filled bins of ``other`` come in; bins with their items go; displaced items are best-fitted."""
        good = [b for b, r in zip(other.bins, other.room, strict=True) if r <= (1 - WELL_FILLED) * self.capacity] or other.bins
        taken = [good[k] for k in rng.permutation(len(good))[: max(1, len(good) // 2)]]
        keep, displaced = self.without({i for b in taken for i in b})
        return Packing(self.lengths, self.capacity, [list(b) for b in keep + taken]).refilled(displaced, rng)

    def mutated(self, rng: np.random.Generator) -> Packing:
        """The emptiest bins and a few others are emptied and their items placed anew."""
        order = np.argsort(self.room)[::-1]
        few = max(2, len(order) // 50)
        drop = {int(k) for k in order[:few]} | {int(k) for k in rng.integers(0, len(order), few)}
        kept = [list(b) for k, b in enumerate(self.bins) if k not in drop]
        return Packing(self.lengths, self.capacity, kept).refilled([i for k in drop for i in self.bins[k]], rng)

    def refilled(self, items: list[int], rng: np.random.Generator) -> Packing:
        """Displaced items first replace smaller ones in bins that this fills better, then what is left is best-fitted."""
        out = sorted(items, key=lambda i: self.lengths[i])
        sizes = [self.lengths[i] for i in out]
        for k in rng.permutation(len(self.bins)).tolist():
            while self.room[k] and self._swap(k, out, sizes):
                pass
        return self.filled(out)

    def _swap(self, k: int, out: list[int], sizes: list[int]) -> bool:
        """Put one or two items of ``out`` (of ascending ``sizes``) in the place of one or two of bin ``k`` if this fills it better."""
        size, room, members = self.lengths, self.room[k], self.bins[k][-SWAPS:]
        leaving = [(size[i], (i,)) for i in members]
        leaving += [(size[i] + size[j], (i, j)) for n, i in enumerate(members[:12]) for j in members[n + 1 : 12]]
        best, found = 0, None
        for gone, who in leaving:
            limit = gone + room
            at = bisect_right(sizes, limit) - 1
            if at >= 0 and sizes[at] - gone > best:
                best, found = sizes[at] - gone, (who, (at,))
            # Two come in: the largest partner of each of the candidates nearest below the limit. A partner is no larger than
            # its candidate, so candidates of half of what it takes to do better end the search, as a full bin does.
            for first in range(at, max(-1, at - SWAPS), -1):
                one = sizes[first]
                if best == room or 2 * one <= gone + best:
                    break
                second = bisect_right(sizes, limit - one, 0, first) - 1
                if second >= 0 and one + sizes[second] - gone > best:
                    best, found = one + sizes[second] - gone, (who, (first, second))
            if best == room:
                break
        if not found:
            return False
        who, come = found
        self.bins[k] = [i for i in self.bins[k] if i not in who] + [out[n] for n in come]
        for n in sorted(come, reverse=True):
            del out[n], sizes[n]
        for i in who:
            at = bisect_right(sizes, size[i])
            out.insert(at, i)
            sizes.insert(at, size[i])
        self.room[k] = room - best
        return True

    def codes(self) -> list[int]:
        code = [0] * len(self.lengths)
        for k, b in enumerate(self.bins):
            for i in b:
                code[i] = k
        return code


def from_codes(lengths: list[int], capacity: int, code: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for item, k in enumerate(code):
        bins.setdefault(k, []).append(item)
    return Packing(lengths, capacity, list(bins.values()))


def least_bins(lengths: list[int], capacity: int) -> int:
    return -(-sum(lengths) // capacity)


def evolve(lengths: list[int], capacity: int, elites: list[list[int]], seed: int) -> tuple[list[Packing], int]:
    """Some generations on one island from the elites that it has and got: its best, and how many crossovers there were."""
    rng = np.random.default_rng(seed)
    items, least, crossovers = list(range(len(lengths))), least_bins(lengths, capacity), 0
    people = [from_codes(lengths, capacity, e) for e in elites]
    while len(people) < POPULATION:
        # A random half of the items is best-fitted before the rest: other bins than plain best fit makes.
        half = rng.random(len(items)) < 0.5
        people.append(Packing(lengths, capacity).filled([i for i in items if half[i]]).filled([i for i in items if not half[i]]))
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(GENERATIONS):
        if len(people[0].bins) == least:
            break
        a, b = rng.permutation(min(4, len(people)))[:2]
        child = people[a].crossed(people[b], rng)
        crossovers += 1
        people[-2:] = [child, child.mutated(rng)]
        people.sort(key=Packing.fitness, reverse=True)
    return people[:ELITES], crossovers


def _seeds(capacity: int):
    """Plain best fit of each group, and whether it misses the least number of bins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for group, lengths in zip(frame["group"], frame["lengths"], strict=True):
                lengths = list(map(int, lengths))
                found = Packing(lengths, capacity).filled(list(range(len(lengths))))
                out.append((group, found.codes(), len(found.bins), len(found.bins) > least_bins(lengths, capacity)))
            yield pd.DataFrame(out, columns=["group", "code", "bins", "open"])

    return run


def _epoch(capacity: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for group, island, lengths, elites in zip(frame["group"], frame["island"], frame["lengths"], frame["elites"], strict=True):
                lengths = list(map(int, lengths))
                best, crossovers = evolve(lengths, capacity, [list(map(int, e)) for e in elites], zlib.crc32(f"{group} {island} {epoch}".encode()))
                out.append((group, island, lengths, [p.codes() for p in best], *best[0].fitness(), len(best[0].bins) > least_bins(lengths, capacity), crossovers))
            yield pd.DataFrame(out, columns=["group", "island", "lengths", "elites", "bins", "filling", "open", "crossovers"])

    return run


def evolved_groups(listed: DataFrame, capacity: int, label: str) -> DataFrame:
    """``group, code, bins, crossovers`` of groups ``group, lengths``: the bin of each of the group's items.

    Groups where plain best fit needs as few bins as their total length does are done. The others are given to islands
    that evolve apart; after each epoch the best packing of an island goes to the next one of its group, and groups
    that have reached the bound leave.
    """
    spark = listed.sparkSession
    spread = lambda df: df.repartition(4 * spark.sparkContext.defaultParallelism)
    seeds = materialize(spread(listed).mapInPandas(_seeds(capacity), "group long, code array<long>, bins long, open boolean"), f"{label}-seeds")
    found = seeds.select("group", "code", "bins", F.lit(0.0).alias("filling"), F.lit(0).cast("long").alias("crossovers"))
    state = listed.join(seeds.where("open"), "group").select("group", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.array("code").alias("elites"))
    schema = "group long, island int, lengths array<long>, elites array<array<long>>, bins long, filling double, open boolean, crossovers long"
    for epoch in range(EPOCHS):
        done = materialize(spread(state).mapInPandas(_epoch(capacity, epoch), schema), f"{label}-epoch{epoch}")
        found = found.unionByName(done.select("group", F.col("elites")[0].alias("code"), (-F.col("bins")).alias("bins"), "filling", "crossovers"))
        still = done.groupBy("group").agg(F.min("open").alias("open")).where("open").select("group")
        if epoch + 1 == EPOCHS or not still.limit(1).count():
            break
        moved = done.select("group", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elites")[0].alias("migrant"))
        state = done.join(still, "group").join(moved, ["group", "island"]).select("group", "island", "lengths", F.array_append("elites", F.col("migrant")).alias("elites"))
    return found.groupBy("group").agg(F.max_by("code", F.struct(-F.col("bins"), "filling")).alias("code"), F.min("bins").alias("bins"), F.sum("crossovers").alias("crossovers"))


def pack_groups(pieces: DataFrame, capacity: int, label: str) -> DataFrame:
    """``row, length`` with ``group`` and ``bin``: each group's pieces packed by ``evolved_groups``.

    Groups are dealt by a hash of the row's number, so their sizes don't depend on keys.
    """
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    member = F.struct("length", "row").alias("m")
    dealt = pieces.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"), member)
    listed = materialize(dealt.groupBy("group").agg(F.sort_array(F.collect_list("m")).alias("members")), f"{label}-groups")
    best = evolved_groups(listed.select("group", F.transform("members", lambda m: m["length"]).alias("lengths")), capacity, label)
    placed = listed.join(best, "group").select("group", F.explode(F.arrays_zip("members", "code")).alias("x"))
    return placed.select("group", F.col("x.code").alias("bin"), "x.members.*")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` for each row, so that few sequences of ``capacity`` are used.

    ``pieces`` has a ``length`` column and any others. Full pieces are sequences of their own. The others are packed in
    groups; what lies in bins that stay poorly filled is packed once more over all groups. Rows are told apart by
    a number each, so keys may lack or repeat.
    """
    with small_arrow_batches(pieces.sparkSession):
        pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    first = materialize(pack_groups(pieces.where(F.col("length") < capacity).select("row", "length"), capacity, "pack-a"), "pack-first")
    fill = first.groupBy("group", "bin").agg(F.sum("length").alias("used"))
    closed = first.join(fill.where(F.col("used") >= CLOSED * capacity), ["group", "bin"], "left_semi")
    rest = first.join(fill.where(F.col("used") < CLOSED * capacity), ["group", "bin"], "left_semi")
    second = pack_groups(rest.select("row", "length"), capacity, "pack-b")
    whole = pieces.where(F.col("length") == capacity).select(F.col("row").alias("group"), F.lit(0).cast("long").alias("bin"), "length", "row")
    packed = whole.withColumn("round", F.lit(0)).unionByName(closed.withColumn("round", F.lit(1))).unionByName(second.withColumn("round", F.lit(2)))
    inside = W.partitionBy("round", "group", "bin").orderBy(F.col("length").desc(), "row").rowsBetween(W.unboundedPreceding, -1)
    packed = packed.select(
        "row",
        # Round in the two highest bits used, then group, then bin: numbers of different rounds never meet.
        (F.col("round").cast("long") * (1 << 60) + F.when(F.col("round") == 0, F.col("group")).otherwise(F.col("group") * (1 << 20) + F.col("bin"))).alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )
    return pieces.join(packed, "row").drop("row")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack every document; ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    An empty table gives no rows; an empty or null text gives one piece, its end id.
    """
    return pack(token_pieces(documents, tokenizer_path, capacity, end_id), capacity).withColumnRenamed("key", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
