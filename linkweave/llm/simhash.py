"""SimHash fingerprints and near-duplicate links by meet-in-the-middle ball hashing.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of all
word shingles of a text, repeats included.

Links: fingerprints at ``2 r`` or fewer differing bits share a variant within ``r`` of
both.  So every fingerprint emits all its variants within ``r``, and the shuffle brings
equal variants together.  All that meet at a variant lie within ``2 r`` of each other,
so tying each to the smallest there loses no link and needs no pairs within a group.

Two steps keep that affordable without dropping anything.  Equal fingerprints are one
from the start.  And a fingerprint without a possible partner emits nothing: cut the 64
bits in three blocks; at ``d`` differing bits, two of the blocks hold ``2 d / 3`` or
fewer of them, so partners meet among the variants, within half of that, of one of the
three pairs of blocks.  Those that meet nobody there have no partner, nor has a fingerprint
that meets just one other there, further away than ``d`` bits.

Defined results: null and empty texts and texts without a word have fingerprint zero,
which is linked like any other; rows with equal ids all stay; a null id is never a
component's name unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .components import components
from .places import Placed

SEED = 42
#: Bits of each byte value, from the lowest.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole sequence if it is shorter."""
    import xxhash

    split = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bytes_ = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    if len(bytes_) < 400:
        return np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(bytes_[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    return of_hashes(shingle_hashes(text, words))


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingle hashes, repeats included."""
    n = len(hashes)
    return int((np.uint64(1) << np.flatnonzero(2 * bit_counts(hashes) > n).astype(np.uint64)).sum()) if n else 0


def with_fingerprints(docs: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs and ``__lw_fp long`` (the fingerprint's 64 bits, signed)."""
    def run(at: int, names: list[str]):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.array([fingerprint(x.as_py(), words) for x in batch.column(at)], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found.view(np.int64), pa.int64())], names=[*names, "__lw_fp"])

        return each

    return storage.mapped(docs, keep, run, "__lw_fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball(bits: list[int], radius: int) -> list[int]:
    """All masks with ``radius`` or fewer of the given bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]


def _longs(values: list[int]) -> str:
    return "array(" + ",".join(f"{_signed(v)}L" if _signed(v) > -(1 << 63) else "bigint('-9223372036854775808')" for v in values) + ")"


def possible(fps: DataFrame, radius: int) -> DataFrame:
    """Those of the distinct ``fps(fp)`` that may have a partner at ``radius`` or fewer bits; misses none."""
    cuts = [0, 21, 42, 64]
    blocks = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    half = -(-(2 * radius // 3) // 2)
    tries = []
    for left_out in range(3):
        kept = [b for i, x in enumerate(blocks) if i != left_out for b in x]
        mask, tag = sum(1 << b for b in kept), (left_out + 1) << blocks[left_out][0]
        tries += [(mask, tag | v) for v in ball(kept, half)]
    # One array of (mask, change) pairs in the plan, folded to a constant.
    pairs = F.expr(f"arrays_zip({_longs([m for m, _ in tries])}, {_longs([c for _, c in tries])})")
    keyed = fps.select("fp", F.explode(pairs).alias("t")).select("fp", F.col("t.0").bitwiseAND(F.col("fp")).bitwiseXOR(F.col("t.1")).alias("key"))
    # Most that meet by chance meet in twos: then their distance says whether they may be partners.
    far = (F.col("size") == 2) & (_distance("least", "most") > radius)
    return _met(keyed).filter(~far).select("fp").distinct()


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _met(keyed: DataFrame) -> DataFrame:
    """Rows of distinct ``keyed(fp, key)`` whose key other fingerprints have too, with the smallest, the largest and the number there: one sort, read once."""
    at = Window.partitionBy("key")
    return keyed.withColumns({"least": F.min("fp").over(at), "most": F.max("fp").over(at), "size": F.count("*").over(at)}).filter("least <> most")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct ``fps(fp)`` with the components that all links within ``radius`` bits give."""
    variants = _longs(ball(list(range(64)), -(-radius // 2)))
    emitted = fps.select("fp", F.explode(F.expr(variants)).alias("v")).select("fp", F.col("fp").bitwiseXOR(F.col("v")).alias("key"))
    tied = _met(emitted).filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return tied.filter(_distance("a", "b") <= radius)  # true of all that meet; verified all the same


def classes(found: DataFrame, radius: int) -> DataFrame:
    """(fp, class long) of the distinct fingerprints of ``found(fp)`` that have a partner within ``radius`` bits."""
    if radius % 2:
        raise ValueError("ball hashing needs an even radius: all that meet at a variant are linked")
    with storage.scratch(found.sparkSession):
        distinct = storage.written(found.select("fp").distinct(), "fingerprints")
        able = storage.written(possible(distinct, radius), "possible")
        return storage.written(components(links(able, radius)).select(F.col("node").alias("fp"), F.col("component").alias("class")), "classes", last=True)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size) of every document, and its columns ``keep``.

    component_id: the smallest doc_id reachable over links between fingerprints.
    """
    marked = storage.written(with_fingerprints(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *keep), words, ["doc_id", *keep]).withColumnRenamed("__lw_fp", "fp"), "marked")
    found = classes(marked, radius)
    # One row a fingerprint from here on; copies only rejoin at the end.
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(found, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    named = by_fp.groupBy("class").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    names = by_fp.select("fp", "class").join(named, "class").select("fp", "component_id", "component_size")
    return marked.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size", *keep)


def first_row() -> Column:
    """What the first row of a group is the least of: ids in order, null ones last, then places."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")


def others(marked: DataFrame, by_fp: DataFrame, found: DataFrame) -> DataFrame:
    """(file, row) of all rows of ``marked(file, row, fp)`` but the first of each class of ``found(fp, class)``.

    ``by_fp(fp, first)`` has the first row of each fingerprint.
    """
    first = by_fp.join(found, "fp", "left").groupBy(F.coalesce("class", "fp").alias("class")).agg(F.min("first").alias("first"))
    stay = first.select("first.file", "first.row")
    return storage.written(marked.select("file", "row").join(stay, ["file", "row"], "left_anti"), "others", last=True)


def without_near_duplicates(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """``docs``, of each group of near-duplicate fingerprints only the row with the smallest doc_id.

    Only places and fingerprints are written and shuffled.
    """
    placed = Placed(docs)
    doc_id, text = placed.column("doc_id"), placed.column("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x.as_py(), words) for x in batch.column(3)], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64), pa.int64())], names=["file", "row", "doc_id", "fp"])

    with storage.scratch(docs.sparkSession):
        marked = storage.written(placed.mapped(["file", "row", doc_id, text], run, f"file long, row long, doc_id {placed.types[doc_id]}, fp long"), "marked")
        gone = others(marked, marked.groupBy("fp").agg(F.min(first_row()).alias("first")), classes(marked, radius))
    return placed.without(gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
