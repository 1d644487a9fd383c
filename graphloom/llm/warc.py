"""WARC as a chunked record table: rows of record identifier and chunk number, with incremental digests.

The bytes of an archive are the ``data`` of its rows in the order of record and chunk: chunk 0 is the record header and
the HTTP header, the chunks after it are pieces of the payload, the last one ends with the record's two line ends. No
step holds a whole record besides the value that Spark gives it: payloads are cut out of the Arrow buffer, and the
reader goes on from chunk to chunk with a running digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, partitions, small_batches

#: Bytes of payload in a chunk.
CHUNK = 1 << 20
#: The most repeated digests that are broadcast (about 100 bytes each).
DIGESTS = 500_000
#: The places that a repeated digest is dealt to beyond that.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = pa.schema([("archive", pa.int32()), ("record_id", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("digest", pa.string())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("intact", pa.bool_())])


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _header(kind: str, record: str, url: str | None, date: str, size: int, digest: str, length: int, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + length}"]
    if kind == "revisit":
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    return ("\r\n".join(fields) + "\r\n\r\n" + http).encode()


def chunked(pages: DataFrame, archives: int, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, record_id, chunk, data, digest): the chunk rows of a WARC record for each row of ``pages``.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest key is the response, the others
    are revisits of it; rows that repeat that key and payload are responses too. A null payload is empty. ``digest`` is
    that of the payload up to the end of the chunk. Null keys are written as such and are never referred to.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialise(first.filter("first is not null").drop("n"))
    # payloads stay where they are while the repeated digests are few; more of them are met in a shuffle of all rows,
    # with each digest in SALTS places, so that a page that is repeated without end is no hot key
    if first.count() <= DIGESTS:
        rows = rows.join(F.broadcast(first), "sha", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["sha", "salt"], "left")
    rows = rows.withColumn("refers", F.expr(f"if(octet_length(payload) >= {least} and first <> coalesce(page_id, -1 - first), first, null)"))

    def run(batches):
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row in range(batch.num_rows):
                page, link, refers = (batch.column(i)[row].as_py() for i in (0, 1, 3))
                view = memoryview(batch.column(2)[row].as_buffer())
                sha = bytes.fromhex(batch.column(4)[row].as_py())
                kind, length = ("response", len(view)) if refers is None else ("revisit", 0)
                where = int.from_bytes(hashlib.blake2b(str((page, link)).encode(), digest_size=8).digest()) % archives
                # rows may repeat as a whole: the record is told apart by its task and place there
                mark, place = uuid.uuid5(uuid.NAMESPACE_URL, f"{task} {place} {page} {link} {sha.hex()}"), place + 1
                record = f"<urn:page:{'' if page is None else page}:{mark}>"
                running, out, held = hashlib.sha1(), [], 0
                out.append((where, record, 0, _header(kind, record, link, date, len(view), base32(sha), length, refers), base32(running.digest())))
                for n, at in enumerate(range(0, length, chunk), 1):
                    piece = view[at : at + chunk]
                    running.update(piece)
                    out.append((where, record, n, bytes(piece), base32(running.digest())))
                    held += len(piece)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if length <= chunk and len(out) > 1 or not length:  # the usual record: its end goes with its last chunk
                    last = out.pop()
                    out.append((*last[:3], last[3] + b"\r\n\r\n", last[4]))
                else:
                    out.append((where, record, -(-length // chunk) + 1, b"\r\n\r\n", base32(running.digest())))
                yield _rows(out)

    return rows.select("page_id", "url", "payload", "refers", "sha").mapInArrow(run, "archive int, record_id string, chunk int, data binary, digest string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNKS.types, strict=True)], schema=_CHUNKS)


def write_archives(pages: DataFrame, path: str, archives: int = 64, **options) -> None:
    """Writes the chunk table of ``pages`` as Parquet under ``path``, on any store that Spark writes."""
    chunked(pages, archives, **options).write.mode("overwrite").parquet(path)


class _Record:
    """A record as its chunks go by: fields, bytes so far and the running digest of the payload."""

    def __init__(self, record: str, head: bytes):
        fields, _, rest = head.partition(b"\r\n\r\n")
        self.fields = dict(x.split(": ", 1) for x in fields.decode().split("\r\n")[1:])
        http, _, rest = rest.partition(b"\r\n\r\n")
        self.size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        self.left = int(self.fields["Content-Length"]) - len(http) - 4
        self.sha, self.read, self.tail = hashlib.sha1(), 0, b""
        self.feed(rest)

    def feed(self, data: bytes) -> None:
        view = memoryview(data)
        self.sha.update(view[: self.left])
        self.read += min(len(view), self.left)
        if len(view) > self.left:
            self.tail += bytes(view[self.left :])
        self.left = max(0, self.left - len(view))

    def row(self) -> tuple:
        kind, digest = self.fields["WARC-Type"], self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page = self.fields["WARC-Record-ID"].split(":")[2]
        refers = self.fields.get("WARC-Refers-To", "").rpartition(":")[2].rstrip(">")
        size, found = self.size, digest
        if kind == "response":  # what was read; a revisit has no payload to look at
            size, found = self.read, base32(self.sha.digest())
        intact = self.left == 0 and self.tail == b"\r\n\r\n" and size == self.size and found == digest
        return int(page) if page else None, size, found, kind, int(refers) if refers else None, self.fields.get("WARC-Target-URI"), intact


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact) of each record under ``path``.

    Length and digest of a response are those of the bytes read, of a revisit those that its header names. ``intact``:
    the record ends as it should and, for a response, length and digest are those of its header.
    """
    table = spark.read.parquet(path)
    ordered = table.select("record_id", "chunk", "data").repartition(partitions(spark), "record_id").sortWithinPartitions("record_id", "chunk")

    def run(batches):
        record, last, out = None, None, []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORDS.types, strict=True)], schema=_RECORDS)

        for batch in batches:
            for i in range(batch.num_rows):
                name, chunk, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_buffer()
                if chunk == 0:
                    if record is not None:
                        out.append(record.row())
                    record = _Record(name, bytes(data))
                else:
                    record.feed(data)
                last = name
            if len(out) > 4096:
                yield rows()
                out.clear()
        if last is not None:
            out.append(record.row())
        if out:
            yield rows()

    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean")
