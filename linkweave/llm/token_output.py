"""Token ids as binary files: one id array a shard, document boundaries in Elias-Fano.

File (all little-endian): ``LWTOKEN2``, the ids of all documents one after the other
(16 bits each while the vocabulary allows it, else 32), the document ends and the
document ids as Elias-Fano sequences with their directories, a JSON footer that says
where they are, its length in 4 bytes, ``LWTOKEN2``.  Documents are found by select, and
read in blocks whose borders select gives: no table of 64-bit offsets is kept or made.

Documents are range-partitioned on their id, equal ids on a hash of the text.  Each task
streams its range to shards of at most ``SHARD_DOCS`` documents (written whole or not at
all, under names of their own), and the start of a document in the whole corpus is the
shard's base plus its start in the shard.

Defined results: a null or empty text has the end id alone; null ids come first;
rows with equal ids all stay, ordered by a hash of the text and the text; an empty table
gives no shard and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .chunks import ChunkMemo, added_tokens, require_byte_level
from .elias_fano import EliasFano

MAGIC = b"LWTOKEN2"
#: Documents and ids of a shard, about.
SHARD_DOCS, SHARD_IDS = 1 << 18, 1 << 28
_ENCODERS: dict[tuple[int, int], ChunkMemo] = {}


def _encoder(definition: str, width: int) -> ChunkMemo:
    """The tokenizers library behind a memo; one for each worker process."""
    key = (hash(definition), width)
    if key not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        kind = np.dtype(f"<u{width}")
        _ENCODERS[key] = ChunkMemo(lambda texts: [np.array(x.ids, kind).tobytes() for x in tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)], added_tokens(definition))
    return _ENCODERS[key]


class ShardWriter:
    """Streams documents, in ascending order of id, to one shard."""

    def __init__(self, out, width: int):
        self.out, self.width, self.ends, self.doc_ids, self.nulls, self.n = out, width, array("q"), array("q"), 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n += len(ids) // self.width
        self.ends.append(self.n)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def full(self) -> bool:
        return len(self.ends) >= SHARD_DOCS or self.n >= SHARD_IDS

    def close(self) -> None:
        least = self.doc_ids[0] if self.doc_ids else 0
        ends = EliasFano.of(np.frombuffer(self.ends, np.int64)).to_bytes()
        # Differences of 64-bit ids need all 64 bits, unsigned.
        names = EliasFano.of(np.frombuffer(self.doc_ids, np.uint64) - np.uint64(least % (1 << 64))).to_bytes()
        self.out.write(ends + names)
        at = len(MAGIC) + self.n * self.width
        foot = json.dumps({"width": self.width, "ids": self.n, "docs": len(self.ends), "ends": [at, len(ends)], "doc_ids": [at + len(ends), len(names)], "least": least, "nulls": self.nulls}).encode()
        self.out.write(foot + len(foot).to_bytes(4, "little") + MAGIC)


class Shard:
    """A shard opened for reading; ids of single documents are read by range."""

    def __init__(self, uri: str):
        fs, path = storage.filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._at(max(0, size - 4096), min(size, 4096))
        if tail[-8:] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n = int.from_bytes(tail[-12:-8], "little")
        self.foot = json.loads(tail[-12 - n : -12])
        self.kind = np.dtype(f"<u{self.foot['width']}")
        self.ends = EliasFano.from_bytes(self._at(*self.foot["ends"]))
        self._names = EliasFano.from_bytes(self._at(*self.foot["doc_ids"]))

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def __len__(self) -> int:
        return self.foot["docs"]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.foot["nulls"] else self.foot["least"] + self._names.select(i - self.foot["nulls"])

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Ids of the documents from i to j."""
        nulls = self.foot["nulls"]
        return [None] * (min(j, nulls) - min(i, nulls)) + (self._names.values(max(i - nulls, 0), max(j - nulls, 0)) + self.foot["least"]).tolist()

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.foot["width"]
        return np.frombuffer(self._at(len(MAGIC) + start * width, (end - start) * width), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.span(i))

    def blocks(self, at_once: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, first id, ends, ids) of runs of documents of about ``at_once`` ids; select finds their borders."""
        i, start = 0, 0
        while i < len(self):
            j = max(i + 1, self.ends.above(start + at_once))
            ends = self.ends.values(i, j)
            yield i, start, ends, self.ids(start, int(ends[-1]))
            i, start = j, int(ends[-1])

    def close(self) -> None:
        self.file.close()


MANIFEST = "part int, piece int, path string, docs long, ids long"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs(doc_id, text)`` to shards in ``folder``; return their manifest, written there too.

    The manifest has one row a shard: part and piece (ascending with doc_id), path, docs, ids.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    require_byte_level(definition)
    meant = json.loads(definition)
    largest = max([end_id, *meant["model"]["vocab"].values(), *(x["id"] for x in meant.get("added_tokens", []))])
    width = 2 if largest < 1 << 16 else 4
    end = end_id.to_bytes(width, "little")
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        documents = ((i, x.as_py() or "") for b in batches for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        document = next(documents, None)
        encode = _encoder(sent.value, width) if document is not None else None
        piece = 0
        while document is not None:
            counts = {}

            def produce(out) -> None:
                nonlocal document
                shard = ShardWriter(out, width)
                while document is not None and not shard.full():
                    shard.add(document[0], encode.text(document[1]) + end)
                    document = next(documents, None)
                shard.close()
                counts.update(docs=len(shard.ends), ids=shard.n)

            uri = f"{folder}/ids-{part:06d}-{piece:06d}-{attempt}.tok"
            storage.write_whole(uri, produce)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "path": [uri], "docs": pa.array([counts["docs"]], pa.int64()), "ids": pa.array([counts["ids"]], pa.int64())})
            piece += 1

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    path = f"{folder}/manifest"
    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(path)
    return docs.sparkSession.read.schema(MANIFEST).parquet(path)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, piece, index) of each document, from the shards."""
    bases = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("part", "piece")) - F.col("ids"))  # a row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                for i, start, ends, ids in shard.blocks():
                    cuts = np.concatenate([[start], ends])
                    at = (cuts - start).tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(i, i + len(ends)), pa.int64()), pa.array(cuts[:-1] + row["base"], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64()), pa.array([row["part"]] * len(ends), pa.int32()), pa.array([row["piece"]] * len(ends), pa.int32()), pa.array(range(i, i + len(ends)), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "piece", "index"])
                shard.close()

    spread = bases.repartition(max(1, manifest.count()), "part", "piece")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, piece int, index int")


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the shards of ``docs`` and read them back, as ``read_shards``."""
    folder = folder or storage.new_path(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, tokenizer_path, folder, end_id))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import BPE_FILE, table

    return token_output(table(spark, sf_dir, "documents"), BPE_FILE())
