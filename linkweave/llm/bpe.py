"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

Encoding a piece: an Aho-Corasick automaton over the reversed vocabulary gives, in
one pass over the reversed piece, the longest token that starts at each byte.  The
encoder takes that token; where it may not follow the token before it, it falls back
to the longest token that is a prefix of it, and where none is left it goes back one
token and marks the place as a dead end.  Two tokens may stand side by side if no
merge across their border would have come before the merges inside them; that table
is filled as pairs are met.  Each place is a dead end at most once, so the time is
linear in the piece, and the result is what applying the merges in order gives.

Decoding: the bytes of all tokens lie in one array; offsets say where each begins.

Texts are cut as the pre-tokenizer cuts them; texts of added tokens are found first
and stand for themselves.  Defined results: a null text is empty; an empty text has no
ids; every row gives one row, repeated ones too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkMemo, require_byte_level

#: How a byte-level vocabulary cuts text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the pair table and of the piece memo that a process keeps.
KEPT = 500_000
#: Token ids decoded at once.
SLICE = 400_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens in the order of their merges: the 256 bytes, then one token a merge, then added ones."""

    def __init__(self, definition: str):
        meant = json.loads(definition)
        letters = byte_letters()
        ids = meant["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in meant.get("added_tokens", [])}
        self.bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes[i] = token.encode() if token in self.added else bytes(letters[c] for c in token)
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in meant["model"]["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made, pair = ids[left + right], (ids[left], ids[right])
            self.merged[pair] = made
            self.parts.setdefault(made, pair)
        if list(self.parts) != sorted(self.parts):
            raise ValueError("ids must follow the order of the merges")

    def offset_table(self) -> tuple[np.ndarray, np.ndarray]:
        return table_of(self.bytes)


def table_of(items: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All items in one array, and where each begins (one entry more than items)."""
    ends = np.cumsum([0, *map(len, items)], dtype=np.int64)
    return np.frombuffer(b"".join(items), np.uint8), ends


def gather(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the ids one after the other, and the place where each ends."""
    starts = offsets[ids]
    lengths = offsets[ids + 1] - starts
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return blob[at].tobytes(), ends


class Encoder:
    def __init__(self, definition: str):
        import ahocorasick
        import regex

        require_byte_level(definition)
        self.vocabulary = v = Vocabulary(definition)
        usable = {i for pair in v.merged for i in pair} | set(v.merged.values()) | {i for i, b in enumerate(v.bytes) if len(b) == 1}
        usable -= set(v.added.values())
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(v.bytes[i][::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        id_of = {v.bytes[i]: i for i in sorted(usable, reverse=True)}
        self.shorter = {}  # the longest token that is a proper prefix
        for text, i in id_of.items():
            self.shorter[i] = next((id_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in id_of), None)
        self.length = [len(b) for b in v.bytes]
        self.compatible: dict[int, bool] = {}
        self.pieces = regex.compile(PIECES).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self.kind = np.dtype("<u2" if len(v.bytes) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.memo = ChunkMemo(self._chunks, list(v.added))

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between the two, undoing their merges from the last to the first."""
        parts, merged = self.vocabulary.parts, self.vocabulary.merged
        before = len(self.length) + 1  # merges from this id on come too late
        while True:
            across = merged.get((left, right))
            if across is not None and across < before:
                return False
            inner_left, inner_right = parts.get(left), parts.get(right)
            if inner_left is None and inner_right is None:
                return True
            # At the same rank the left one was made first, so the right one is undone first.
            if inner_right is None or (inner_left is not None and left > right):
                before, left = left, inner_left[1]
            else:
                before, right = right + 1, inner_right[0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(data)
        longest: list[int | None] = [None] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            start = n - 1 - end
            if longest[start] is None or self.length[token] > self.length[longest[start]]:
                longest[start] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, length, compatible = 0, self.length, self.compatible
        token = longest[0] if n else None
        while at < n:
            while token is not None:
                if not dead[at + length[token]]:
                    if not out:
                        break
                    pair = out[-1] << 32 | token
                    ok = compatible.get(pair)
                    if ok is None:
                        ok = self._may_follow(out[-1], token)
                        if len(compatible) < KEPT:
                            compatible[pair] = ok
                    if ok:
                        break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            else:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
        return out

    def _chunks(self, chunks: Sequence[str]) -> list[bytes]:
        out = []
        known = self.known
        for chunk in chunks:
            got = []
            for piece in (chunk,) if chunk[1:].isalpha() and chunk[0] == " " else self.pieces(chunk):
                ids = known.get(piece)
                if ids is None:
                    ids = np.array(self.piece(piece.encode()), self.kind).tobytes()
                    if len(known) < KEPT:
                        known[piece] = ids
                got.append(ids)
            out.append(b"".join(got))
        return out

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.added and any(x in text for x in self.vocabulary.added):
            cut = self.added.split(text)
            data = b"".join(self.vocabulary.added[x].to_bytes(self.kind.itemsize, "little") if i % 2 else self.memo.text(x) for i, x in enumerate(cut))
        else:
            data = self.memo.text(text)
        return np.frombuffer(data, self.kind)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.blob, self.offsets = vocabulary.offset_table()

    def data(self, ids: np.ndarray) -> bytes:
        return gather(self.blob, self.offsets, ids)[0]

    def text(self, ids: np.ndarray) -> str:
        return self.data(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_MADE: dict[int, tuple] = {}


def _made(definition: str) -> tuple:
    """Encoder, decoder and table of decimals; one for each worker process."""
    key = hash(definition)
    if key not in _MADE:
        encoder = Encoder(definition)
        _MADE[key] = encoder, Decoder(encoder.vocabulary), table_of([b"%d," % i for i in range(len(encoder.vocabulary.bytes))])
    return _MADE[key]


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _made(sent.value)[0]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.ids(x.as_py() or "").astype(np.int32) for x in batch.column(1)], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>")


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, decimals = _made(sent.value)
        for batch in batches:
            names, counts, of_ids, of_text = batch.column(0), [], [], []
            held: list[np.ndarray] = []

            def digest(held, of_ids=of_ids, of_text=of_text) -> None:
                """Digests of some documents' ids, gathered for all of them together."""
                ids = np.concatenate(held).astype(np.int64)
                for table, into, end in ((decimals, of_ids, 1), ((decoder.blob, decoder.offsets), of_text, 0)):
                    sums, left, at = [hashlib.sha256() for _ in held], [len(x) for x in held], 0
                    for first in range(0, len(ids), SLICE):
                        data, ends = gather(*table, ids[first : first + SLICE])
                        view, done, upto = memoryview(data), 0, 0
                        while done < len(ends):
                            while not left[at]:
                                at += 1
                            take = min(left[at], len(ends) - done)
                            left[at] -= take
                            done += take
                            stop = int(ends[done - 1])
                            sums[at].update(view[upto : stop - (end if not left[at] else 0)])  # no comma after the last id
                            upto = stop
                    into += [x.hexdigest() for x in sums]

            for text in batch.column(1):
                ids = encoder.ids(text.as_py() or "")
                counts.append(len(ids))
                held.append(ids)
                if sum(map(len, held[-1:])) > SLICE or len(held) >= 256:
                    digest(held)
                    held = []
            if held:
                digest(held)
            yield pa.RecordBatch.from_arrays([names, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import BPE_FILE, table

    return round_trip_digests(table(spark, sf_dir, "documents"), BPE_FILE())
