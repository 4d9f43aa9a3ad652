"""Operator 10: byte-level BPE encoding with offsets, and decoding."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import sized_batches, small_batches, table, text_or_empty
from vigia.llm.tokenizer import encoder_from_ranks, ranks_from_tiktoken

_bytes_of: dict[str, list[bytes]] = {}


def byte_table(content: bytes) -> list[bytes]:
    """The bytes of each id; an id that is missing stands for none."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _bytes_of:
        ranks = ranks_from_tiktoken(content)
        table_ = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table_[rank] = token
        _bytes_of[key] = table_
    return _bytes_of[key]


def char_offsets(text: str, tokens: list[bytes]) -> tuple[list[int], list[int]]:
    """First and past-the-last character of each token.

    A token that ends or starts inside a character of several bytes counts that character as its own, so
    the tokens of a split character overlap there.
    """
    starts = [0, *accumulate(len(letter.encode("utf-8")) for letter in text)]  # byte at which each character starts
    first, last, at = [], [], 0
    for token in tokens:
        first.append(bisect_right(starts, at) - 1)
        at += len(token)
        last.append(bisect_right(starts, at - 1) if token else first[-1])
    return first, last


def encode(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id", offsets: bool = True) -> DataFrame:
    """Ids of each whole text: ``key, ids array<int>`` and, if asked for, ``starts`` and ``ends`` in characters.

    Null counts as the empty text, which has no ids. Repeated rows each keep a row. Special tokens in a text
    are ordinary text. An empty table gives no rows. The work is one pass over Arrow batches without a shuffle.
    """
    with open(ranks_path, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, parts = encoder_from_ranks(sent.value, pattern), byte_table(sent.value)
        for batch in sized_batches(batches, 1, 2 << 20):
            ids, ends = encoder.encode_array(batch.column(1))
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32)))]
            if offsets:
                both = [char_offsets(x, [parts[i] for i in y]) for x, y in zip(batch.column(1).to_pylist(), np.split(ids, ends[:-1]), strict=True)]
                columns += [pa.array([b[k] for b in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "starts", "ends"][: len(columns)])

    return documents.select(key, text_or_empty(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The bytes of each list of ids (``data``) and their text (``text``), which is null unless they are UTF-8.

    Tokens may split a character: bytes are joined first and read as text afterwards.
    """
    with open(ranks_path, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = byte_table(sent.value)
        for batch in small_batches(batches):
            data = [b"".join(map(parts.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[key, "data"])

    joined = encoded.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, data binary")
    return joined.withColumn("text", F.when(F.is_valid_utf8(F.col("data").cast("string")), F.col("data").cast("string")))


def round_trip(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode each text in one pass, keeping only counts and digests of the ids and bytes.

    Null counts as the empty text, which has no ids. Repeated rows and rows without a key each keep a row; an empty
    table gives none.
    """
    with open(ranks_path, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, parts = encoder_from_ranks(sent.value, pattern), pa.array(byte_table(sent.value), pa.large_binary())
        shown = pa.array([str(k) for k in range(len(parts))], pa.large_string())
        for batch in sized_batches(batches, 1):
            ids, ends = encoder.encode_array(batch.column(1))
            cuts, ids = pa.array(np.r_[0, ends], pa.int64()), pa.array(ids)
            joined = lambda names, mark: pc.binary_join(pa.LargeListArray.from_arrays(cuts, names.take(ids)), mark)  # noqa: E731,B023
            ids_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined(shown, pa.scalar(" ", pa.large_string()))]
            data_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined(parts, pa.scalar(b"", pa.large_binary()))]
            columns = [batch.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(ids_sha), pa.array(data_sha)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(key, text_or_empty(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
