"""WARC archives of pages: writing with revisits, and a reader that splits files.

Writing: each task writes one gzipped archive, a gzip member a record, whole or not at
all.  Of pages with equal payloads of ``LEAST`` bytes or more, the one with the largest
id is a response, the others are revisits that refer to it.

Reading: an archive is cut in byte ranges.  A task scans its range for the gzip magic,
and takes the first candidate whose member decodes to a WARC header with a block of the
stated length; from there it walks from member to member.  It owns the records that
start in its range, and reads past its end to finish the last one.  What does not decode
is skipped up to the next candidate; but the manifest says how many records each archive
has, and an archive that gives another number is an error, so nothing is lost unseen.

Defined results: a null html is an empty payload; pages with equal payloads and equal
ids are all responses; a null id or url stays null or empty; rows with equal ids all
stay; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

MAGIC = b"\x1f\x8b\x08"
#: Payloads below so many bytes are always stored.
LEAST = 1000
#: Bytes of a range.
SPLIT = 16 << 20
#: Bytes given to the inflater at once.
STEP = 1 << 14
LEVEL = 4
#: Parts that pages of one payload are dealt to, where the copies are too many to broadcast.
SALT = 16
DATE = "1970-01-01T00:00:00Z"
#: The revisit profile of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit without."""
    body = b"" if refers_to is not None else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    shown = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {shown}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


class Member:
    """A decoded record: headers (lower-case names), block and where the member ends."""

    def __init__(self, headers: dict[str, str], block: bytes, end: int):
        self.headers, self.block, self.end = headers, block, end

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


class RangeReader:
    """The records of one file that start in [start, end)."""

    def __init__(self, uri: str, start: int, end: int):
        fs, path = storage.filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.start, self.end = start, min(end, self.size)
        self.at, self.data = start, b""

    def _bytes(self, place: int, n: int) -> bytes:
        if place < self.at or place + n > self.at + len(self.data):
            self.file.seek(place)
            self.at, self.data = place, self.file.read(max(n, 1 << 20))
        return self.data[place - self.at : place - self.at + n]

    def member(self, place: int) -> Member | None:
        """The record whose gzip member starts at ``place``, or None if none does."""
        inflate, out, at = zlib.decompressobj(31), [], place
        try:
            while not inflate.eof:
                piece = self._bytes(at, STEP)
                if not piece:
                    return None
                out.append(inflate.decompress(piece))
                if len(out) == 1 and not b"WARC/1.".startswith(out[0][:7]):
                    return None
                at += len(piece)
        except zlib.error:
            return None
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            return None
        lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in lines}
        n = headers.get("content-length", "")
        if not n.isdigit() or "warc-type" not in headers or rest[int(n) :] != b"\r\n\r\n":
            return None
        return Member(headers, rest[: int(n)], at - len(inflate.unused_data))

    def _candidate(self, place: int) -> int:
        """The next gzip magic at or after ``place`` and before the range's end; -1: none."""
        while place < self.end:
            piece = self._bytes(place, 1 << 20)
            found = piece.find(MAGIC)
            if found >= 0:
                return place + found if place + found < self.end else -1
            if len(piece) <= 2:
                return -1
            place += len(piece) - 2
        return -1

    def records(self) -> Iterator[tuple[int, Member]]:
        place = self._candidate(self.start)
        while 0 <= place < self.end:
            found = self.member(place)
            if found is None:
                place = self._candidate(place + 1)
            else:
                yield place, found
                place = found.end
        self.file.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives; return the manifest, one row a file."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload")})
    # Only digests are shuffled, summed up before; and only those of copies are joined, on as many tasks as one page needs.
    copies = slim.filter(F.col("length") >= LEAST).groupBy("digest", "length").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").drop("n")
    known = storage.written(copies, "payload-copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    refers = F.when(F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")), F.col("target"))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    ready = salted.join(known, ["digest", "length", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        uri, counts = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz", [0]

        def produce(out) -> None:
            batch = first
            while batch is not None:
                for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                    out.write(record(*(x.as_py() for x in row)))
                    counts[0] += 1
                batch = next(batches, None)

        size = storage.write_whole(uri, produce)
        yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": pa.array([size], pa.int64()), "records": pa.array(counts, pa.int64())})

    path = f"{folder}/manifest"
    ready.mapInArrow(write, MANIFEST).write.parquet(path)
    return pages.sparkSession.read.schema(MANIFEST).parquet(path)


def read_archives(manifest: DataFrame, split: int = SPLIT) -> DataFrame:
    """RECORDS of all archives of ``manifest(path, bytes, records)``, written once.

    Digests of stored payloads are checked, and the number of records of each archive.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for range_ in batch.to_pylist():
                rows = []
                for offset, found in RangeReader(range_["path"], range_["start"], range_["start"] + split).records():
                    h = found.headers
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    length = int(h["warc-payload-length"])
                    if h["warc-type"] == "response":
                        payload = found.payload()
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != length:
                            raise ValueError(f"{range_['path']} at {offset}: the payload does not have its digest")
                    rows.append({"page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": _page(h.get("warc-refers-to")), "path": range_["path"], "offset": offset})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    ranges = manifest.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    found = storage.written(ranges.repartition(max(1, ranges.count()), "path", "start").mapInArrow(read, RECORDS), "records")
    counts = found.groupBy("path").agg(F.count("*").alias("found"))
    wrong = manifest.join(counts, "path", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("records <> found").select("path", "records", "found").limit(5).collect()
    if wrong:
        raise ValueError(f"archives do not have the records they should: {[tuple(r) for r in wrong]}")
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import table

    manifest = write_archives(table(spark, sf_dir, "pages"), storage.new_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT t, max(page_id) AS target FROM p WHERE n >= {LEAST} GROUP BY t)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.target <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.target <> p.page_id THEN m.target END AS refers_to
FROM p LEFT JOIN m ON p.t = m.t
"""
