"""Operator 1: word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm.common import table, text_or_empty
from vigia.llm.tokenizer import byte_alphabet

#: A vocabulary file larger than this isn't sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of the words that one Python worker remembers, with what an entry needs besides; then it forgets all.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 160
#: Longer words are counted anew each time.
MEMO_WORD_BYTES = 1 << 10


class LongestMatch:
    """Counts greedy longest-match pieces of a word in time linear in its length.

    The vocabulary is a trie over word starts (``initial``) and word continuations. A node's failure link
    leads to the node that stands for what remains after its longest pieces are popped off the front, and
    ``popped`` counts those pieces. A word without a full match is one unknown piece.
    """

    def __init__(self, initial: list[str], inner: list[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # node 0: word start, node 1: continuation
        self.piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for text in pieces:
                node = root
                for letter in text:
                    node = self.children[node].setdefault(letter, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                        self.piece.append(False)
                if text:
                    self.piece[node] = True
        self.failure: list[int | None] = [None] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = [0, 1]
        for node in queue:
            for letter, child in self.children[node].items():
                queue.append(child)
                if self.piece[child]:
                    self.failure[child], self.popped[child] = 1, 1
                    continue
                at, count = self.failure[node], self.popped[node]
                while at is not None and letter not in self.children[at]:
                    count += self.popped[at]
                    at = self.failure[at]
                if at is not None:
                    self.failure[child], self.popped[child] = self.children[at][letter], count

    def count(self, word: str) -> int:
        node, total = 0, 0
        for letter in word:
            while (after := self.children[node].get(letter)) is None:
                total += self.popped[node]
                node = self.failure[node]
                if node is None:
                    return 1
            node = after
        while node != 1:
            total += self.popped[node]
            node = self.failure[node]
            if node is None:
                return 1 if word else 0
        return total


_automata: dict[int, tuple] = {}


class _Counts(dict):
    """Counts of words met before in this worker, emptied when they fill their bytes; very long words aren't kept."""

    def __init__(self, automaton: LongestMatch, spell):
        self.automaton, self.spell, self.bytes = automaton, spell, 0

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.spell(word))
        if len(word) <= MEMO_WORD_BYTES:
            self.bytes += len(word) + ENTRY_BYTES
            if self.bytes > MEMO_BYTES:
                self.clear()
                self.bytes = len(word) + ENTRY_BYTES
            self[word] = n
        return n


def _counts_for(content: str) -> _Counts:
    key = hash(content)
    if key not in _automata:
        vocabulary = json.loads(content)["model"]["vocab"]
        letters = byte_alphabet()
        start = letters[0x20]
        inner = [token for token in vocabulary if not token.startswith(start)]
        initial = [token[1:] for token in vocabulary if token.startswith(start) and len(token) > 1]
        # A word start that no start piece matches may be taken by continuation pieces, as byte-level ids allow.
        automaton = LongestMatch(list({*initial, *(t for t in inner if len(t) == 1)}), inner)
        _automata[key] = _Counts(automaton, lambda word: "".join(map(letters.__getitem__, word)))
    return _automata[key]


def token_counts(documents: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Word and greedy word-piece counts of each text.

    Words are runs of characters other than ASCII white space. Null and empty texts have no words and no
    tokens. Repeated rows and rows without a key each keep a row; an empty table gives none; other columns are not
    looked at. The result has the columns
    ``key``, ``n_words`` and ``n_tokens``. There is no shuffle.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        content = file.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {len(content)} characters; at most {MAX_VOCABULARY_BYTES} are sent to executors")
    sent = documents.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = _counts_for(sent.value)
        for series in texts:
            words = [value.encode().split() for value in series]
            yield pd.DataFrame({"n_words": [len(w) for w in words], "n_tokens": [sum(map(counts.__getitem__, w)) for w in words]})

    return documents.select(F.col(key), count(text_or_empty(text)).alias("c")).select(key, "c.n_words", "c.n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

