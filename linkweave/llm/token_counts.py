"""Greedy word-piece counts by a longest-match automaton, without building pieces.

The vocabulary is a trie.  Each node has a failure link and the number of tokens that
are popped when the match fails there: the greedy pieces of what was read, as far as
they are certain.  A word is read once, byte by byte, popping counts on the way, so
the time is linear in its length however the pieces overlap.

Words are runs of other bytes than space, tab, newline, vertical tab, form feed and
carriage return; the piece that begins a word is matched with one space before it, as
byte-level vocabularies write it.  A word that the vocabulary cannot spell counts as
one token.  Counts of words are remembered up to a bound.

Defined results: a null, empty or blank text has no words and no tokens; every row
gives one row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary

#: Words that a worker process remembers at most.
MEMO = 800_000


class LongestMatch:
    def __init__(self, tokens: Iterable[bytes]):
        go: dict[int, int] = {}
        parent, last, is_token = [0], [0], [False]
        for token in tokens:
            node = 0
            for byte in token:
                child = go.get(node << 8 | byte)
                if child is None:
                    child = go[node << 8 | byte] = len(parent)
                    parent.append(node)
                    last.append(byte)
                    is_token.append(False)
                node = child
            is_token[node] = bool(node)
        self.go = go
        self.fail, self.pops = [-1] * len(parent), [0] * len(parent)
        depth_order = sorted(range(1, len(parent)), key=self._depths(parent).__getitem__)
        for node in depth_order:
            if is_token[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, pops = self.fail[parent[node]], self.pops[parent[node]]
            while at >= 0 and (at << 8 | last[node]) not in go:
                pops += self.pops[at]
                at = self.fail[at]
            self.fail[node], self.pops[node] = (go[at << 8 | last[node]], pops) if at >= 0 else (-1, 0)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _depths(parent: list[int]) -> list[int]:
        depth = [0] * len(parent)
        for node in range(1, len(parent)):  # a node is made after its parent
            depth[node] = depth[parent[node]] + 1
        return depth

    def count(self, data: bytes) -> int:
        """Number of greedy longest pieces of ``data``; 1 if they cannot spell it."""
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for byte in data:
            while (child := go.get(node << 8 | byte)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else 1

    def word(self, word: bytes) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.count(b" " + word)
            if len(self.known) < MEMO:
                self.known[word] = n
        return n


_MADE: dict[int, LongestMatch] = {}


def _made(definition: str) -> LongestMatch:
    key = hash(definition)
    if key not in _MADE:
        vocabulary = Vocabulary(definition)
        _MADE[key] = LongestMatch(b for i, b in enumerate(vocabulary.bytes) if i not in set(vocabulary.added.values()))
    return _MADE[key]


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _made(sent.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                split = (text.as_py() or "").encode().split()
                found = list(map(automaton.known.get, split))
                if None in found:
                    found = [automaton.word(w) if n is None else n for w, n in zip(split, found, strict=True)]
                words.append(len(split))
                tokens.append(sum(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import BPE_FILE, table

    return token_counts(table(spark, sf_dir, "documents"), BPE_FILE())
