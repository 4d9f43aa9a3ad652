"""Operator 6: token ids in files of fixed-width bit-packed blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigia.llm.common import partitions, scratch_root, sized_batches, small_batches, table, text_or_empty
from vigia.llm.tokenizer import encoder_from_json, with_end

#: A block is closed at the end of the document that takes it to this many ids.
BLOCK_IDS = 1 << 16
#: One row of the file format: a block of whole documents. ``starts`` are the documents' places in the
#: block, ``block_start`` is the block's place in its shard, ``payload`` has ``width`` bits for each id.
BLOCK = "shard int, block int, block_start long, first_id long, last_id long, width int, n_ids long, keys array<long>, starts array<long>, payload binary"


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, most significant bit first; the last byte is filled with zeros."""
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` up to ``stop`` of a block; only the bytes that hold them are looked at."""
    if width == 16:
        return np.frombuffer(payload, ">u2", stop - start, 2 * start).astype("<u4")
    first = start * width // 8
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)[first : -(-stop * width // 8)])
    skip = start * width - 8 * first
    grid = bits[skip : skip + (stop - start) * width].reshape(-1, width)
    return (grid.astype(np.uint32) << np.arange(width - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Encode every whole text, append ``end_id`` and write all ids in ascending order of ``key``.

    Null counts as the empty text (one id, the end id). Rows that share a key stay together, in the order of
    the input; null keys come first. An empty table makes no blocks. Ranges of key and place go to shards of their own,
    so rows of one key may fill several shards and no task sees more than a range; the files are written by Spark's
    committed writer, which survives lost executors.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    sent, width = spark.sparkContext.broadcast(content), bits_for(Tokenizer.from_str(content).get_vocab_size())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_from_json(sent.value)
        shard, block, block_start = TaskContext.get().partitionId(), 0, 0
        keys: list[int] = []
        parts: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal block, block_start, keys, parts, n
            ids = np.concatenate(parts)
            starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
            known = [k for k in keys if k is not None]
            values = (shard, block, block_start, min(known, default=None), max(known, default=None), width, n, keys, starts.tolist(), pack(ids, width))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            row = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])
            block, block_start, keys, parts, n = block + 1, block_start + n, [], [], 0
            return row

        for batch in sized_batches(batches, 1):
            ids, ends = with_end(*encoder.encode_array(batch.column(1)), end_id)
            for k, value in zip(batch.column(0).to_pylist(), np.split(ids, ends[:-1]), strict=True):
                keys.append(k)
                parts.append(value)
                n += len(value)
                if n >= BLOCK_IDS:
                    yield close()
        if parts:
            yield close()

    rows = documents.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(partitions(spark), "key", "place").sortWithinPartitions("key", "place")
    ordered.select("key", "text").mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: ``key, start, n_tokens, ids_crc32``, all from the files."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each shard, not for each document.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", before.alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 16):
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"])
                starts = np.array(row["starts"], np.int64)
                ends = np.append(starts[1:], row["n_ids"])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["shard"], np.int32)), pa.array(row["keys"], pa.int64()), pa.array(starts + row["block_start"]), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["shard", "key", "place", "n_tokens", "ids_crc32"],
                )

    read = blocks.mapInArrow(run, "shard int, key long, place long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(shards), "shard").select("key", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, key: int) -> list[list[int]]:
    """The ids of the documents with this key, by random access to the blocks that may hold it."""
    blocks = spark.read.schema(BLOCK).parquet(path).where((F.col("first_id") <= key) & (F.col("last_id") >= key)).orderBy("shard", "block")
    found = []
    for row in blocks.toLocalIterator():
        ends = [*row["starts"][1:], row["n_ids"]]
        found += [unpack(row["payload"], row["width"], a, b).tolist() for k, a, b in zip(row["keys"], row["starts"], ends, strict=True) if k == key]
    return found


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).withColumnRenamed("key", "doc_id")
