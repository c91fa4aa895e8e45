"""Near-duplicates by the exact Jaccard similarity of word shingles.

SimHash fingerprints propose, by the balls of ``simhash``: all that are tied within 4 bits.
As similar texts may differ in more bits, MinHash bands propose too; what is proposed is decided on the two texts' whole sets of
shingle hashes.  A pair at the least similarity of 4/5 meets in none of the 36 bands of 5
with a chance of ``(1 - 0.8 ** 5) ** 36``, that is 6 in 10 million.

Equal sets are one from the start.  Sets that balls and bands hold together are a family.  A small
family is one task's work, where all are compared.  In a large one a set of which too few
shingles are in any other set cannot be similar to any, by its size alone, and is done;
families are then formed anew of those that are left.  In those that are still large

* the set that meets most others is the hub of each bucket it is in, and all of a bucket
  are compared with its hub alone: most of a group of copies hangs together by that;
* what is left outside the family's largest group, and may still be similar to another,
  is compared with the family in tiles of bounded size.  No pair is ever a row.

So a group costs its size times a few hubs, and the last step only what is near the
least similarity and not held by a hub.

Defined results: texts without a word have the empty set, and are copies of each other;
sets of under four shingles have no partner but their copies; rows of null or repeated
ids are rows of their own; an empty table gives no rows; columns of any name are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash, storage
from .components import components
from .places import Placed, look_up, write_beside

#: Least similarity of linked texts, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 36, 5
#: Bits within which fingerprints propose a pair.
RADIUS = 4
#: Shingles hashed at once.
HELD = 2048
#: Members and shingles of a family that one task compares as a whole.
SMALL, SMALL_SHINGLES = 512, 2_000_000
#: Shingles of a tile: of the sets that are left, and of those they are compared with.
TILE_LEFT, TILE_RIGHT = 200_000, 1_000_000
#: Parts that the members tied to a hub are dealt to.
SALT = 16
_RANDOM = np.random.default_rng(42).integers(0, (1 << 64) - 1, (2, BANDS * ROWS, 1), dtype=np.uint64)
_XOR, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in ascending order."""
    return np.unique(simhash.shingle_hashes(text, words))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; equal where the band's minima are. None for sets that only a copy can be similar to."""
    if len(found) < SIMILAR[0]:
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), HELD):
        least = np.minimum(least, ((found[at : at + HELD] ^ _XOR) * _TIMES).min(axis=1))
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        keys = (keys ^ least[:, i]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def with_bands(docs: Placed, words: int) -> DataFrame:
    """(file, row, doc_id, fp, n, simhash, bands): of each text a hash of its set, the set's size, the SimHash fingerprint of its shingles and the set's bands."""
    import xxhash

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, sizes, prints, bands = [], [], [], []
        for x in batch.column(3):
            hashes = simhash.shingle_hashes(x.as_py(), words)
            prints.append(simhash.of_hashes(hashes))
            found = np.unique(hashes)
            whole.append(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED))
            sizes.append(len(found))
            bands.append(band_keys(found))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(bands)], names=["file", "row", "doc_id", "fp", "n", "simhash", "bands"])

    doc_id, text = docs.column("doc_id"), docs.column("text")
    return docs.mapped(["file", "row", doc_id, text], run, f"file long, row long, doc_id {docs.types[doc_id]}, fp long, n long, simhash long, bands array<long>")


def with_sets(docs: Placed, words: int, asked: DataFrame) -> DataFrame:
    """(fp, family, small, n, shingles) of the texts at the places of ``asked(file, row, fp, family, small)``."""
    manifest = write_beside(asked.select("file", "row", "fp", "family", F.col("small").cast("long")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, values = look_up(manifest, batch.column(0).to_numpy(), batch.column(1).to_numpy(), 3)
        values = values[found]
        sets = [shingle_set(x.as_py(), words) for x in batch.column(2).filter(pa.array(found))]
        return pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1]), pa.array(values[:, 2] != 0), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["fp", "family", "small", "n", "shingles"])

    return docs.mapped(["file", "row", docs.column("text")], run, "fp long, family long, small boolean, n long, shingles array<long>")


def alike(shared: Column, m: Column, n: Column) -> Column:
    """Whether sets of ``m`` and ``n`` members that share so many have the least similarity, in whole numbers."""
    top, bottom = SIMILAR
    return (top + bottom) * shared >= top * (m + n)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``sets(fp, n, shingles)`` are similar; few ``b`` may have many ``a``."""
    one = sets.select(F.col("fp").alias("a"), F.col("n").alias("m"), F.col("shingles").alias("of_a"))
    two = sets.join(pairs.select(F.col("b").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("b"), "n", F.col("shingles").alias("of_b"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    both = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int")).join(one, "a").join(two, ["b", "salt"])
    return both.filter(alike(F.size(F.array_intersect("of_a", "of_b")), F.col("m"), F.col("n"))).select("a", "b")


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Places of all similar pairs of a set on the left and one on the right; none may be empty."""
    known, codes = np.unique(np.concatenate(right), return_inverse=True)
    sizes = np.array([len(x) for x in right])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(known), np.int64)
    top, bottom = SIMILAR
    for i, x in enumerate(left):
        at = np.searchsorted(known, x)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == x)]
        mark[at] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[at] = 0
        for j in np.flatnonzero((top + bottom) * shared >= top * (len(x) + sizes)).tolist():
            yield i, j


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows of equal first ``keys`` columns; the last column is a set."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 1)), (np.sort(x.values.to_numpy()) for x in b.column(b.num_columns - 1)), strict=True))
    for _, group in groupby(rows, lambda r: r[:keys]):
        yield list(group)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def links_of_small(sets: DataFrame) -> DataFrame:
    """Links (a, b) of ``sets(family, fp, shingles)``: all of a family are compared in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            own = [r[2] for r in group]
            yield _pairs(spanning((group[i][1], group[j][1], i, j) for i, j in linked(own, own) if i < j))

    return sets.select("family", "fp", "shingles").repartition("family").sortWithinPartitions("family").mapInArrow(run, "a long, b long")


def spanning(pairs: Iterator[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(a, b) of those of ``(a, b, group of a, group of b)`` that join groups not joined before: no more than groups."""
    to: dict[int, int] = {}

    def top(g: int) -> int:
        while g in to:
            g = to[g]
        return g

    out = []
    for a, b, x, y in pairs:
        x, y = top(x), top(y)
        if x != y:
            to[x] = y
            out.append((a, b))
    return out


def links_to_hubs(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of members of each bucket of ``met(key, fp)`` with the one of it that meets most others."""
    at = Window.partitionBy("key")
    met = met.join(sets.select("fp"), "fp").withColumn("size", F.count("*").over(at))
    weighed = met.join(met.groupBy("fp").agg(F.sum("size").alias("meets")), "fp")
    hub = F.max(F.struct("meets", "fp")).over(at)["fp"]
    tied = weighed.select(F.col("fp").alias("a"), hub.alias("b")).filter("a <> b").distinct()
    return similar(storage.written(tied, "tied"), sets)


def able(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``members(family, fp, n, ...)`` that may be similar to another of their family; ``sets(family, fp, shingles)`` are theirs.

    The shingles that no other set of the family has are counted out: what is left must
    be enough to be similar to a set of the least possible size.
    """
    each = sets.select("family", "fp", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("family", "shingle").agg(F.count("*").alias("sets"), F.min("fp").alias("fp")).filter("sets = 1").groupBy("fp").agg(F.count("*").alias("alone"))
    least = members.groupBy("family").agg(F.min("n").alias("least"))
    top, bottom = SIMILAR
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * top / bottom))
    left = members.join(alone, "fp", "left").join(least, "family").filter(alike(F.col("n") - F.coalesce("alone", F.lit(0)), F.col("n"), partner))
    return left.select(*members.columns)


def families(met: DataFrame) -> DataFrame:
    """(fp, family) of ``met(key, fp)``: what buckets hold together; those without company are not returned."""
    tied = met.withColumn("least", F.min("fp").over(Window.partitionBy("key"))).filter("fp <> least")
    return components(tied.select(F.col("fp").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("fp"), F.col("component").alias("family"))


def links_of_rest(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between different ``groups(node, component)`` of one family of ``sets(family, fp, n, shingles)``."""
    own = sets.select("family", "fp", "n").join(groups, F.col("fp") == F.col("node"), "left").select("family", "fp", "n", F.coalesce("component", "fp").alias("own"))
    largest = own.groupBy("family", "own").agg(F.count("*").alias("members")).groupBy("family").agg(F.max(F.struct("members", "own"))["own"].alias("main"), F.count("*").alias("groups"))
    open_ = storage.written(own.join(largest.filter("groups > 1").drop("groups"), "family"), "open")
    left = storage.written(able(open_, sets.join(open_.select("fp"), "fp", "left_semi")).withColumn("left", F.col("own") != F.col("main")), "able")
    tiles = left.groupBy("family").agg(F.ceil(F.sum(F.when(F.col("left"), F.col("n"))) / TILE_LEFT).cast("int").alias("rows"), F.ceil(F.sum("n") / TILE_RIGHT).cast("int").alias("columns"))
    dealt = left.join(tiles.filter("rows > 0"), "family").join(sets.select("fp", "shingles"), "fp")

    def sent(df: DataFrame, is_left: bool) -> DataFrame:
        mine = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        at = (mine("rows").alias("row"), every("columns").alias("column")) if is_left else (every("rows").alias("row"), mine("columns").alias("column"))
        return df.select("family", *at, F.lit(is_left).alias("is_left"), "fp", "own", "shingles")

    both = sent(dealt.filter("left"), True).unionByName(sent(dealt, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            left, right = ([r for r in group if r[3] is side] for side in (True, False))
            if left and right:
                pairs = ((left[i], right[j]) for i, j in linked([r[6] for r in left], [r[6] for r in right]))
                yield _pairs(spanning((x[4], y[4], x[5], y[5]) for x, y in pairs))

    return both.repartition("family", "row", "column").sortWithinPartitions("family", "row", "column").mapInArrow(run, "a long, b long")


def _sized(named: DataFrame) -> DataFrame:
    """``named(fp, family, n)`` and ``small``: whether the family is one task's work."""
    weights = named.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    small = (F.col("members") <= SMALL) & (F.col("weight") <= SMALL_SHINGLES)
    return named.join(weights.select("family", small.alias("small")), "family").select("fp", "family", "n", "small")


def in_balls(by_set: DataFrame) -> DataFrame:
    """(key, fp) of ``by_set(fp, n, simhash)``: sets whose fingerprints the balls of ``simhash`` tie together, where those are several."""
    some = by_set.filter(F.col("n") >= SIMILAR[0]).select("fp", "simhash")
    tied = simhash.classes(some.select(F.col("simhash").alias("fp")), RADIUS).withColumnRenamed("fp", "simhash")
    named = some.join(tied, "simhash", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("class", "simhash")).alias("key"), "fp")
    at = Window.partitionBy("key")
    return named.withColumn("several", F.min("fp").over(at) != F.max("fp").over(at)).filter("several").select("key", "fp")


def classes(by_set: DataFrame, sets_of) -> DataFrame:
    """(fp, class) of the rows of ``by_set(fp, n, simhash, bands)`` that are similar to another one.

    ``sets_of(fps)`` gives ``(fp, family, small, n, shingles)`` of the rows of ``fps(fp, family, small)``.
    """
    at = Window.partitionBy("key")
    keyed = by_set.select("fp", F.explode("bands").alias("key"))
    company = F.min("fp").over(at) != F.max("fp").over(at)
    met = storage.written(keyed.withColumn("met", company).filter("met").select("key", "fp").unionByName(in_balls(by_set)), "met")
    named = storage.written(_sized(families(met).join(by_set.select("fp", "n"), "fp")), "families")
    sets = storage.written(sets_of(named), "sets")
    links = storage.written(links_of_small(sets.filter("small")), "links")
    large = sets.filter("not small").drop("small")
    if large.limit(1).count():
        left = storage.written(able(large.select("family", "fp", "n"), large).select("fp", "n"), "able")
        met = storage.written(met.join(left.select("fp"), "fp"), "met")
        again = storage.written(_sized(families(met).join(left, "fp")), "families")
        sets = storage.written(large.select("fp", "shingles").join(again, "fp").select("family", "fp", "n", "small", "shingles"), "sets")
        links = links.unionByName(storage.written(links_of_small(sets.filter("small")), "links"))
        large = sets.filter("not small").drop("small")
        if large.limit(1).count():
            to_hubs = storage.written(links_to_hubs(met, large), "links")
            links = links.unionByName(to_hubs).unionByName(storage.written(links_of_rest(large, components(to_hubs)), "links"))
    return components(links).select(F.col("node").alias("fp"), F.col("component").alias("class"))


def without_near_duplicates(docs: DataFrame, words: int) -> DataFrame:
    """``docs``, of each group of texts that links of the least similarity hold together only the row with the smallest doc_id.

    Only sets of families, bands and places are shuffled: texts are scanned three times.
    """
    placed = Placed(docs)
    with storage.scratch(docs.sparkSession):
        marked = storage.written(with_bands(placed, words), "marked")
        by_set = storage.written(marked.groupBy("fp").agg(F.min(simhash.first_row()).alias("first"), F.first("n").alias("n"), F.min("simhash").alias("simhash"), F.first("bands").alias("bands")), "by_set")

        def sets_of(fps: DataFrame) -> DataFrame:
            return with_sets(placed, words, by_set.select("fp", "first.file", "first.row").join(fps.select("fp", "family", "small"), "fp"))

        gone = simhash.others(marked, by_set, classes(by_set.select("fp", "n", "simhash", "bands"), sets_of))
    return placed.without(gone)
