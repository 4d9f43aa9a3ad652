"""Byte-pair encoding of whole texts with the tokenizers library, as a helper inside Spark tasks.

Invented or natural, most words come again and again, so the library should meet each once. The bytes of a batch of
texts are cut where the word pattern is sure to end a match: before a space or a line break that follows a character
which is not white space, after such a break, and before a full stop or the like that follows a letter. Arrow numbers the distinct pieces of the batch; those not met before are encoded in a
few calls of the library, and the ids of the texts are gathered from those of the pieces with numpy. The ids of the
pieces, put together, are the ids of the text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from itertools import compress, repeat

import numpy as np
import pyarrow as pa

#: Bytes of the pieces that one Python worker remembers, with what an entry needs besides; then it forgets those that did not come again.
MEMO_BYTES, ENTRY_BYTES = 160 << 20, 160
#: Pieces that one call of the library gets; what it builds for a piece is many times as large as the piece.
CALL_PIECES = 4_000
# Fixed value: the word pattern of the byte-level vocabularies that texts are cut for; others are encoded uncut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of letters of two bytes in UTF-8 at most.
LATIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + k) for k, b in enumerate(hidden)}


def ranks_from_tiktoken(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def tokenizer_from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers BPE with the ids of a rank table, matching ``pattern`` first.

    The pair that a token was merged from is the last pair left when its bytes are merged by the lower
    ranks alone.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letters = byte_alphabet()
    show = lambda token: "".join(map(letters.__getitem__, token))
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        if len(token) < 2:
            continue
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1)), default=(rank, 0))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((show(parts[0]), show(parts[1])))
    vocabulary = {show(token): rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


def _cuts(tokenizer) -> bool:
    """Whether the tokenizer matches ``WORDS`` and nothing of it looks across white space."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    if any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    state = json.loads(tokenizer.pre_tokenizer.__getstate__())
    steps = state["pretokenizers"] if state["type"] == "Sequence" else [state]
    if steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"]:
        return False
    if len(steps) == 1:
        return steps[0]["use_regex"]
    return len(steps) == 2 and not steps[1]["use_regex"] and steps[0].get("pattern") == {"Regex": WORDS} and steps[0]["behavior"] == "Isolated" and not steps[0]["invert"]


def _model(tokenizer):
    """The tokenizer's model, without a cache of its own if it is BPE: words come here once, so a cache only takes time."""
    from tokenizers import models

    state = json.loads(tokenizer.to_str())["model"]
    if state.pop("type") != "BPE":
        return tokenizer.model
    merges = [m.split(" ") if isinstance(m, str) else m for m in state.pop("merges")]
    return models.BPE(merges=list(map(tuple, merges)), cache_capacity=0, **{k: v for k, v in state.items() if v is not None})


#: Kinds of bytes. A stop is an ASCII sign that always starts a match after a letter; a lead starts a letter of two bytes.
SIGN, LETTER, STOP, LEAD, INNER, SPACE, BREAK, OTHER = range(8)


def _kinds(added: set[str]) -> np.ndarray:
    """The kind of each byte; signs of added tokens are never cut off."""
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x21:0x7F] = SIGN
    for first, last in ("AZ", "az"):
        kinds[ord(first) : ord(last) + 1] = LETTER
    for sign in ".,;:!?()[]{}#*$%&+-/=\"":
        if sign not in added:
            kinds[ord(sign)] = STOP
    kinds[0xC3:0xC9], kinds[0x80:0xC0] = LEAD, INNER
    kinds[0x20], kinds[0x0A] = SPACE, BREAK
    return kinds


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with ``end_id`` after each text, as little-endian unsigned 32-bit values, and the new ends."""
    out = np.empty(len(ids) + len(ends), "<u4")
    own = np.ones(len(out), bool)
    own[ends + np.arange(len(ends))] = False
    out[own], out[~own] = ids, end_id
    return out, ends + np.arange(1, len(ends) + 1)


class Encoder:
    """Ids of whole texts."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.memo_bytes = MEMO_BYTES
        self.tokenizer, self.cuts = tokenizer, _cuts(tokenizer)
        self.vocabulary_size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.lengths = np.zeros(self.vocabulary_size + 1, np.int64)
        for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
            self.lengths[k] = len(token)
        self.kinds = _kinds({c for t in tokenizer.get_added_tokens_decoder().values() for c in t.content})
        # The same model for words of letters, which need no pattern: each is a match, with a space before it or not. They come
        # one to a line and in the vocabulary's letters, as the library takes longer to turn bytes into these.
        self.words = Tokenizer(_model(tokenizer))
        self.words.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.letters = byte_alphabet() | {10: "\n"}
        self._forget()

    def _forget(self) -> None:
        #: Number of each known piece; its ids are ``pool[start : start + length]``.
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        #: Whether a piece came again in a later batch.
        self.again = np.zeros(1 << 12, bool)
        self.n_ids = self.n_pieces = 0

    def _forget_rare(self) -> None:
        """Keep the pieces that came again since they were learned or last kept, if they take half of the bound at most."""
        known, pool, starts, counts = self.known, self.pool, self.starts, self.counts
        kept = np.flatnonzero(self.again[: self.n_pieces])
        # Pieces are numbered in the order in which the dictionary has them.
        names = list(compress(known, self.again[: self.n_pieces].tolist()))
        self._forget()
        del known
        ids = _gather(pool, starts[kept], counts[kept])
        if self._bytes(names, ids) <= self.memo_bytes // 2:
            self._add(names, ids, counts[kept])

    @staticmethod
    def _bytes(pieces: list[str], ids: np.ndarray) -> int:
        return sum(map(len, pieces)) + ENTRY_BYTES * len(pieces) + 4 * len(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        data, cuts = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end; null counts as empty."""
        if self.bytes > self.memo_bytes:
            self._forget_rare()
        pieces, per_text = self._pieces(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(numbers < 0)
        self.again[numbers[numbers >= 0]] = True
        if len(new):
            names = [distinct[k] for k in new.tolist()]
            self._learn(names)
            numbers[new] = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        which = numbers[coded.indices.to_numpy(zero_copy_only=False)] if distinct else numbers
        lengths = self.counts[which]
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(per_text)]
        return _gather(self.pool, self.starts[which], lengths), ends

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in order, and how many each text has."""
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        limits = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None else np.zeros(0, np.uint8)
        limits = limits - limits[0]
        first = np.zeros(len(raw) + 1, bool)
        if self.cuts and len(raw):
            kind = self.kinds[raw]
            # Bytes that end a character, and one that is not white space: ASCII, or the second byte of a character of two.
            tail = np.zeros(len(raw), bool)
            tail[1:] = (kind[1:] == INNER) & (kind[:-1] == LEAD)
            tail[1:] &= (raw[:-1] != 0xC3) | ((raw[1:] != 0x97) & (raw[1:] != 0xB7))  # the signs of times and division
            letter = (kind == LETTER) | tail
            solid = letter | (kind == STOP) | (kind == SIGN)
            after_solid = ((kind == SPACE) | (kind == BREAK))[1:] & solid[:-1]
            first[1:-1] = after_solid | ((kind == STOP)[1:] & letter[:-1])
            alone = np.flatnonzero((kind[1:-1] == BREAK) & solid[:-2]) + 2
            first[alone[kind[alone] < SPACE]] = True
        first[limits] = True
        first[-1] = True
        starts = np.flatnonzero(first)
        # Empty texts start where the next text does, and have no piece.
        before = np.searchsorted(starts, limits)
        return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)), np.diff(before)

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = self.n_pieces + len(pieces), self.n_ids + len(ids)
        if m > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.n_ids], np.zeros(m, np.uint32)])
        if n > len(self.starts):
            self.starts, self.counts, self.again = (np.concatenate([x[: self.n_pieces], np.zeros(n, x.dtype)]) for x in (self.starts, self.counts, self.again))
        self.pool[self.n_ids : m] = ids
        self.counts[self.n_pieces : n] = counts
        self.starts[self.n_pieces : n] = self.n_ids + np.cumsum(counts) - counts
        self.known.update(zip(pieces, range(self.n_pieces, n), strict=True))
        self.n_pieces, self.n_ids = n, m
        self.bytes += self._bytes(pieces, ids)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known: words of letters in one text each call, other pieces as they are."""
        if self.cuts:
            words, alone = [], []
            for piece in pieces:
                (words if LATIN.fullmatch(piece) else alone).append(piece)
            self._learn_words(words)
        else:
            alone = pieces
        self._learn_alone(alone)

    def _learn_alone(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), CALL_PIECES):
            some = pieces[start : start + CALL_PIECES]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.concatenate(found), np.array([len(x) for x in found], np.int64))

    def _learn_words(self, words: list[str]) -> None:
        """Encode many words in one text and deal the ids out by the lengths of their tokens in bytes."""
        for start in range(0, len(words), CALL_PIECES):
            some = words[start : start + CALL_PIECES]
            raw = "\n".join(some).encode()
            shown = raw.decode("latin-1").translate(self.letters)
            ids = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
            data = np.frombuffer(raw, np.uint8)
            # Bytes of all tokens up to each word's last; line breaks are no token's.
            limits = np.append(np.flatnonzero(data == 10), len(data)) - np.arange(len(some))
            ends = np.cumsum(self.lengths[ids])
            stop = np.searchsorted(ends, limits) + 1
            if len(ids) and ends[-1] == limits[-1] and np.array_equal(ends[stop - 1], limits):
                self._add(some, ids, np.diff(stop, prepend=0))
            else:  # a vocabulary that lacks letters
                self._learn_alone(some)


_built: dict[str, Encoder] = {}


def encoder_from_json(content: str, memo_bytes: int = MEMO_BYTES) -> Encoder:
    """One encoder for each file content and Python worker, which from now on remembers about ``memo_bytes``."""
    from tokenizers import Tokenizer

    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _built:
        _built[key] = Encoder(Tokenizer.from_str(content))
    _built[key].memo_bytes = memo_bytes
    return _built[key]


def encoder_from_ranks(content: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _built:
        _built[key] = Encoder(tokenizer_from_ranks(ranks_from_tiktoken(content), pattern))
    return _built[key]
