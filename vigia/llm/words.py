"""Words of whole texts as Arrow arrays, cut by the classes of their bytes with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, GAP, BREAK = range(3)
#: Bytes of texts that are cut at a time; a longer text is cut alone.
BLOCK_BYTES = 16 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte: of a word, of what stands between words, or of what ends a piece. Only ASCII can part words."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[np.frombuffer(gaps, np.uint8)] = GAP
    kinds[np.frombuffer(breaks, np.uint8)] = BREAK
    return kinds


def cut_words(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """All words of the texts in order with A-Z in lower case, the number of each word's text, and of its piece.

    Null texts have no words. Numbers of pieces only tell whether two words share one.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    limits = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None else np.zeros(0, np.uint8)
    limits = limits - limits[0]
    kind = kinds[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kind == WORD
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # A text's first and last bytes begin and end words, whatever stands in the texts beside it.
    bounds = limits[1:-1][(limits[1:-1] > 0) & (limits[1:-1] < len(raw))]
    begins[bounds], ends[bounds - 1] = inside[bounds + 1], inside[bounds]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.r_[0, np.cumsum(stops - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(_LOWER[raw[inside[1:-1]]]))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, limits)))
    piece = np.cumsum(kind == BREAK, dtype=np.int64)[starts] + owner if len(starts) else np.zeros(0, np.int64)
    return words, owner, piece


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of the batches in tables of about ``size`` bytes of a string column; a longer text is a table of its own."""
    kept: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for k, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                kept.append(batch.slice(start, k - start))
                yield pa.Table.from_batches(kept)
                kept, start, total = [], k, 0
            total += n
        kept.append(batch.slice(start))
    if kept:
        yield pa.Table.from_batches(kept)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array; beyond 2 GB of texts with long offsets."""
    return pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
