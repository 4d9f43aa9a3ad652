"""Operator 5: exact deduplication of a batch against immutable snapshots behind binary-fuse filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import SPACE, materialize, table, text_or_empty

#: Keys of one filter, on average.
BUCKET_KEYS = 100_000
#: Up to this many ids (8 bytes each) are sent to where the texts are read; beyond, the texts are shuffled.
MAX_SENT_IDS = 1_000_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys and seed."""
    x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static three-wise binary-fuse filter with 8-bit fingerprints, built and probed with numpy.

    A key's three slots lie in three consecutive segments; its fingerprint is the exclusive or of the slots.
    Building peels slots that only one key uses, wave after wave, and assigns them in reverse.
    """

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def places(hashed: np.ndarray, segment: int, segments: int) -> np.ndarray:
        start = ((hashed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
        low = np.uint64(segment - 1)
        return np.stack([start + k * segment + ((hashed >> np.uint64(shift)) & low).astype(np.int64) for k, shift in enumerate((0, 9, 18))])

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
        segment = min(segment, 1 << 14)
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
        segments = max(1, -(-int(n * factor) // segment) - 2)
        for seed in range(1, 100):
            hashed = _mix(keys, seed)
            at = cls.places(hashed, segment, segments)
            if (order := cls._peel(at, (segments + 2) * segment)) is not None:
                break
            if seed % 8 == 0:
                segments += max(1, segments // 16)
        else:
            raise RuntimeError("no seed gave a filter that can be peeled")
        slots = np.zeros((segments + 2) * segment, np.uint8)
        prints = (hashed ^ (hashed >> np.uint64(32))).astype(np.uint8)
        for who, slot in reversed(order):
            # The key's own slot is still zero, so the exclusive or of all three is that of the other two.
            slots[slot] = prints[who] ^ slots[at[0, who]] ^ slots[at[1, who]] ^ slots[at[2, who]]
        return cls(seed, segment, slots)

    @staticmethod
    def _peel(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=size)
        users = np.zeros(size, np.int64)  # exclusive or of the keys that use the slot
        for row in at:
            np.bitwise_xor.at(users, row, np.arange(n))
        waves, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):
            who, first = np.unique(users[single], return_index=True)
            slot = single[first]
            waves.append((who, slot))
            left -= len(who)
            touched = at[:, who]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(users, row, who)
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        return None if left else waves

    def holds(self, keys: np.ndarray) -> np.ndarray:
        hashed = _mix(keys.astype(np.uint64), self.seed)
        at = self.places(hashed, self.segment, len(self.slots) // self.segment - 2)
        prints = (hashed ^ (hashed >> np.uint64(32))).astype(np.uint8)
        return prints == (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]])


def normalized(text: str = "text"):
    return F.regexp_replace(text_or_empty(text), f"[{SPACE}]+", " ")


def with_digest(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, text_sha256, digest``: the hash of the normalized text, and its first 60 bits."""
    sha = F.sha2(normalized(text).cast("binary"), 256)
    rows = documents.select(F.col(key).alias("key"), sha.alias("text_sha256"))
    return rows.withColumn("digest", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))


def build_snapshot(digests: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """A snapshot of rows of ``with_digest``: its exact groups, and one filter for each bucket of digests.

    The groups are ``bucket, digest, text_sha256, keep_id, size``. A third of the rows may be one text: groups are
    counted on the map side first, so a bucket holds distinct digests only.
    """
    bucket = F.pmod("digest", F.lit(buckets)).cast("int").alias("bucket")
    groups = digests.groupBy("text_sha256", "digest").agg(F.min("key").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    groups = materialize(groups.select(bucket, "digest", "text_sha256", "keep_id", "size"), "dedup-snapshot")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(frame["digest"].to_numpy())
        return pd.DataFrame([(frame["bucket"].iloc[0], made.seed, made.segment, made.slots.tobytes())], columns=["bucket", "seed", "segment", "slots"])

    filters = groups.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, slots binary")
    return groups, materialize(filters, "dedup-filters")


def screen(digests: DataFrame, filters: DataFrame, buckets: int, salts: int) -> DataFrame:
    """``digest, text_sha256`` and more of a batch's groups, with ``maybe``: the filter can't rule the digest out.

    The snapshot's size gives the number of buckets, the batch's that of ``salts``: parts of a bucket, each of which meets
    a copy of the bucket's filter. So neither a small snapshot nor a large batch makes a large group.
    """
    names = digests.columns
    dealt = digests.withColumns({"bucket": F.pmod("digest", F.lit(buckets)).cast("int"), "salt": F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int")})
    copied = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(batch: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(batch), bool)
        for seed, segment, slots in zip(made["seed"], made["segment"], made["slots"], strict=True):
            maybe |= BinaryFuse(int(seed), int(segment), np.frombuffer(slots, np.uint8)).holds(batch["digest"].to_numpy())
        return batch[names].assign(maybe=maybe)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.schema.fields) + ", maybe boolean"
    return dealt.groupBy("bucket", "salt").cogroup(copied.groupBy("bucket", "salt")).applyInPandas(probe, schema)


def exact_dedup(snapshot: DataFrame, batch: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Groups of equal texts over an immutable snapshot and a new batch.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as
    empty. The row with the smallest key stays; rows that repeat its key and text are marked like it. A null
    key counts as larger than any. Columns: ``key, keep_id, group_size, kept, text_sha256``, one row for each row
    of both inputs; empty inputs give none, and other columns are not looked at.

    The batch's digests are grouped by themselves; filters of the snapshot screen the groups; only groups that
    pass are joined with the snapshot's exact groups, and the bytes of their two keepers' texts are
    compared, so that equal digests of different texts would not be joined.
    """
    spark = snapshot.sparkSession
    old, new = materialize(with_digest(snapshot, text, key), "dedup-old"), materialize(with_digest(batch, text, key), "dedup-new")
    buckets = max(1, -(-old.count() // BUCKET_KEYS))
    groups, filters = build_snapshot(old, buckets)
    fresh = materialize(new.groupBy("text_sha256", "digest").agg(F.min("key").alias("new_id"), F.count(F.lit(1)).alias("new_size")), "dedup-fresh")
    salts = max(1, -(-fresh.count() // (buckets * BUCKET_KEYS)))
    screened = materialize(screen(fresh, filters, buckets, salts), "dedup-screened")
    met = screened.where("maybe").join(groups.drop("bucket"), ["digest", "text_sha256"])
    met = materialize(met.select("text_sha256", "new_id", "keep_id", "new_size", "size"), "dedup-met")
    # Byte checks: one text for each side of a met group, however many rows the group has.
    few = met.count() <= MAX_SENT_IDS

    def bytes_of(rows: DataFrame, name: str) -> DataFrame:
        """The texts of a side's keepers. A key may lack or repeat, so a keeper's text is known by its hash as well."""
        ids = met.select(F.col(name).alias("id")).distinct()
        rows = rows.select(F.col(key).alias(f"{name}_key"), F.col(text).alias("text"))
        found = rows.join(F.broadcast(ids) if few else ids, F.col(f"{name}_key").eqNullSafe(F.col("id")), "left_semi")
        return found.select(normalized().alias(f"{name}_text")).withColumn("text_sha256", F.sha2(F.col(f"{name}_text").cast("binary"), 256)).dropDuplicates(["text_sha256"])

    checked = met.join(bytes_of(batch, "new_id"), "text_sha256").join(bytes_of(snapshot, "keep_id"), "text_sha256")
    equal = checked.where(F.col("new_id_text") == F.col("keep_id_text")).select("text_sha256").distinct()
    joined = met.join(equal, "text_sha256", "left_semi").select("text_sha256", F.least("new_id", "keep_id").alias("keep_id"), (F.col("new_size") + F.col("size")).alias("group_size"))
    alone = lambda df, a, b: df.join(joined, "text_sha256", "left_anti").select("text_sha256", F.col(a).alias("keep_id"), F.col(b).alias("group_size"))
    final = joined.unionByName(alone(groups, "keep_id", "size")).unionByName(alone(screened, "new_id", "new_size"))
    rows = old.select("key", "text_sha256").unionByName(new.select("key", "text_sha256"))
    return rows.join(final, "text_sha256").select("key", "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def halves(documents: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows up to the middle of the keys' range as a snapshot that exists, the others as the batch that comes in.

    Keys are whole numbers; rows without one are in the snapshot. An empty table gives two empty ones.
    """
    low, high = documents.agg(F.min(key), F.max(key)).first()
    middle = 0 if low is None else (low + high) // 2
    older = F.coalesce(F.col(key) <= middle, F.lit(True))
    return documents.where(older), documents.where(~older)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(*halves(documents)).withColumnRenamed("key", "doc_id")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
