"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents longer than the capacity are cut into full pieces, a bin each, and a rest.
Pieces are taken from the longest to the shortest.  Each goes to the bin with the least
room that it fits in and that holds no piece of its source or its duplicate cluster; if
there is none, a new bin is opened.

Bins lie in order of the room they have left, each with a bitmap of its sources and
clusters.  A tree over the rooms keeps, for each span, the bits that all bins in it
share: a span whose shared bits meet the piece's cannot hold it and is passed over at
once, so a hot source does not make the search walk through its own bins.

Documents are dealt by a hash of their id to parts of about ``part`` rows, each packed by one
task alone; no source or cluster is ever gathered in one task.  A part's bins are its own,
so the bin found is the tightest of its part.  What that costs is one bin that stays open
a part and size of piece, and is measured in the README.

Defined results: a null or empty text has length 0 and takes a place in a bin; a null
source or cluster conflicts with nothing; rows with equal ids are packed as rows of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash, storage

#: Bytes of a bin in the query and the pipeline.
CAPACITY = 16_384
#: Rows of a part, about.
PART = 20_000
#: Room is searched in steps of so many to a capacity; within a step bins are compared exactly.
STEPS = 4096
_ALL = -1  # all bits: no bin in the span


class Bins:
    """Bins of one part; ``put`` finds the tightest compatible one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.step = max(1, -(-(capacity + 1) // STEPS))
        n = 1
        while n * self.step <= capacity:
            n *= 2
        self.n = n
        self.shared = [_ALL] * (2 * n)  # a node's children are 2 i and 2 i + 1
        self.leaves: list[dict[int, None]] = [{} for _ in range(n)]
        self.room: list[int] = []
        self.bits: list[int] = []

    def _lift(self, leaf: int, value: int) -> None:
        shared, node = self.shared, leaf + self.n
        shared[node] = value
        while node > 1:
            node //= 2
            both = shared[2 * node] & shared[2 * node + 1]
            if shared[node] == both:
                break
            shared[node] = both

    def _insert(self, b: int) -> None:
        if self.room[b] == 0:
            return  # only pieces without length would fit; they open no search here
        leaf = self.room[b] // self.step
        self.leaves[leaf][b] = None
        self._lift(leaf, self.shared[leaf + self.n] & self.bits[b])

    def _next(self, leaf: int, bits: int) -> int:
        """The first leaf from ``leaf`` on that may have a bin without the bits, or -1."""
        shared, node = self.shared, leaf + self.n
        while shared[node] == _ALL or shared[node] & bits:
            while node & 1:  # the last of its parents
                node //= 2
                if node <= 1:
                    return -1
            if node <= 1:
                return -1
            node += 1
        while node < self.n:
            node *= 2
            if shared[node] == _ALL or shared[node] & bits:
                node += 1
        return node - self.n

    def put(self, length: int, bits: int) -> int:
        """Number of the bin that takes a piece; its bits are added to the bin's."""
        leaf = self._next(max(length, 1) // self.step, bits)
        while leaf >= 0:
            held = self.leaves[leaf]
            best = None
            seen = _ALL
            for b in held:
                if self.bits[b] & bits == 0 and self.room[b] >= length and (best is None or self.room[b] < self.room[best]):
                    best = b
                    if self.step == 1:
                        break
                seen &= self.bits[b]
            if best is not None:
                del held[best]
                if not held:
                    self._lift(leaf, _ALL)
                self.room[best] -= length
                self.bits[best] |= bits
                self._insert(best)
                return best
            self._lift(leaf, seen)  # what removed bins had left behind
            leaf = self._next(leaf + 1, bits) if leaf + 1 < self.n else -1
        self.room.append(self.capacity - length)
        self.bits.append(bits)
        self._insert(len(self.room) - 1)
        return len(self.room) - 1


def pack(pieces: Iterable[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each (length, source, cluster), given from the longest to the shortest; below 0: no constraint.

    Sources and clusters are small integers; clusters that occur once may be given as -1.
    """
    pieces = list(pieces)
    bins, sources = Bins(capacity), {s: i for i, s in enumerate(dict.fromkeys(p[1] for p in pieces if p[1] >= 0))}
    clusters = {c: i + len(sources) for i, c in enumerate(dict.fromkeys(p[2] for p in pieces if p[2] >= 0))}
    out = []
    for length, source, cluster in pieces:
        bits = (1 << sources[source] if source >= 0 else 0) | (1 << clusters[cluster] if cluster >= 0 else 0)
        out.append(bins.put(length, bits))
    return out


def _codes(values: pd.Series, only_repeated: bool) -> pd.Series:
    codes = pd.Series(pd.factorize(values)[0], index=values.index)
    if only_repeated:
        codes = codes.where(values.isin(values[values.duplicated(keep=False)]) & values.notna(), -1)
    return codes


def packed(docs: DataFrame, capacity: int = CAPACITY, length: str = "length", source: str = "source", cluster: str = "cluster", part: int = PART) -> DataFrame:
    """(doc_id, piece, start, length, part, bin, place) of ``docs(doc_id, length, source, cluster)``; ``part``: rows of a part, about.

    ``start``: where the piece begins in its document; ``place``: where it begins in its bin.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("length"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("long").alias("cluster"))
    slim = storage.written(slim, "pieces")
    parts = max(1, -(-slim.count() // part))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        full, rest = frame.length // capacity, frame.length % capacity
        n = (full + ((rest > 0) | (full == 0))).to_numpy()
        out = frame.loc[frame.index.repeat(n), ["doc_id", "length", "part"]]
        out["piece"] = out.groupby(level=0).cumcount()
        out["start"] = out.piece * capacity
        out["length"] = (out.length - out.start).clip(upper=capacity)
        whole = (out.length == capacity).to_numpy()
        loose = out.index[~whole]
        order = out.length[~whole].reset_index(drop=True).sort_values(ascending=False, kind="stable").index
        source, cluster = _codes(frame.source, False), _codes(frame.cluster, True)
        loose_lengths = out.length[~whole].to_numpy()[order]
        rows = loose[order]
        numbers = pack(zip(loose_lengths.tolist(), source[rows].tolist(), cluster[rows].tolist(), strict=True), capacity)
        bins = pd.Series(-1, index=range(len(out)))
        spots = (~whole).nonzero()[0][order]
        bins.iloc[spots] = numbers
        used = max(numbers, default=-1) + 1
        bins.iloc[whole.nonzero()[0]] = range(used, used + int(whole.sum()))
        out["bin"] = bins.to_numpy()
        out = out.reset_index(drop=True)
        taken = out.iloc[[*whole.nonzero()[0], *spots]]
        out["place"] = taken.groupby("bin").length.cumsum() - taken.length
        return out[["doc_id", "piece", "start", "length", "part", "bin", "place"]]

    dealt = slim.withColumn("part", F.pmod(F.xxhash64("doc_id", "length", "source"), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(run, "doc_id long, piece int, start long, length long, part int, bin int, place long")


def by_text(docs: DataFrame) -> DataFrame:
    """Lengths in UTF-8 bytes and an end mark, exact copies as clusters."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + 1).alias("length"), F.xxhash64(text).alias("cluster"))


def by_near_text(docs: DataFrame) -> DataFrame:
    """Lengths in UTF-8 bytes and an end mark, the components of near-duplicate fingerprints as clusters."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    sized = docs.select("doc_id", docs["text"].cast("string").alias("text"), docs["source"].cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("length"))
    return simhash.near_duplicates(sized, keep=("source", "length")).select("doc_id", "source", "length", F.col("component_id").alias("cluster"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    return packed(by_near_text(table(spark, sf_dir, "documents")))
