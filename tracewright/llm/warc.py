"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader's tasks get byte ranges of
files. A task looks for gzip's magic bytes from the start of its range, takes a
place for a record only if what it decodes there begins as a WARC header, and
owns the records that start inside its range; the last of them it reads to its
end, beyond the range. So every record has one owner, however files are cut.

Archives lie in the shared folder, under a URI that pyarrow's file systems
open (a mounted folder, HDFS, S3, GCS). A task writes under a name of its own
and hands it back; files of failed attempts are on no list and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import durable, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, and bytes that are read at once.
RANGE, CHUNK = 32 << 20, 1 << 20
#: Bytes of a member that are decoded first; most members are shorter.
FIRST = 1 << 14
#: Tasks that read at most; beyond, a task has several ranges.
TASKS = 50_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, bytes long, records long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of refers_to that has the payload's length and digest only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid4().urn if page_id is None else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str | None = None, *, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for every page; gives (path, bytes, records) for each archive.

    Of pages with equal payloads of at least `least` bytes the one with the
    smallest key is a response and the others revisit it; smaller ones are
    responses. Null html is an empty payload. Rows that repeat the smallest key
    are responses each; a page without a key never is the smallest, and is a
    response where no other has its payload. No pages, no archives. Other
    columns are not written.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # Counted before they meet: a payload that most pages have is one row of firsts, and its join can be split.
    firsts = rows.groupBy("sha1").agg(F.min("id").alias("first"))
    revisit = (F.octet_length("html") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    typed = rows.join(firsts, "sha1").select("id", "url", "html", "sha1", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        path, out, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                i, at, text, sha1, first = row
                made = record(i, at, text.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), first)
                out.write(made)
                size, n = size + len(made), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    manifest = durable(typed.mapInArrow(run, MANIFEST))
    base = folder if "://" in folder else "file://" + folder
    return manifest.withColumn("path", F.concat(F.lit(base.rstrip("/") + "/"), F.substring_index("path", "/", -1)))


class Source:
    """Bytes of a file from some place on, read as they are needed. What is done with is dropped a CHUNK or more at a time, so that no byte is copied more than a few times."""

    def __init__(self, file, at: int):
        self.file, self.held, self.at, self.first = file, bytearray(), at, 0
        file.seek(at)

    def more(self) -> bool:
        if self.first >= CHUNK:
            del self.held[: self.first]
            self.first = 0
        got = self.file.read(CHUNK)
        self.held += got
        return bool(got)

    def find(self, what: bytes) -> int:
        """How far from here it is; -1 if what is held hasn't it."""
        found = self.held.find(what, self.first)
        return found - self.first if found >= 0 else -1

    def left(self) -> int:
        return len(self.held) - self.first

    def forget(self, n: int) -> None:
        self.first, self.at = self.first + n, self.at + n


def member(source: Source) -> tuple[bytes, int] | None:
    """Content and length of the gzip member at the source's place, if it is a WARC record. What isn't is given up once its first bytes are decoded."""
    z, out, used = zlib.decompressobj(31), bytearray(), 0
    try:
        while not z.eof:
            if used == source.left() and not source.more():
                return None
            at = source.first + used
            part = bytes(source.held[at : at + (CHUNK if used else FIRST)])
            out += z.decompress(part)
            used += len(part) - len(z.unused_data)
            if not b"WARC/1.".startswith(bytes(out[:7])):
                return None
    except zlib.error:
        return None
    return (bytes(out), used) if out.startswith(b"WARC/1.") else None


def parse(content: bytes) -> dict | None:
    """The record's fields; None if its header can't be decoded."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if not mark or "WARC-Type" not in named or not named.get("Content-Length", "").isdigit():
        return None
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s or "")) else None
    length = re.search(rb"(?im)^content-length: (\d+)\r?$", http)
    revisit = named["WARC-Type"] == "revisit"
    return {
        "page_id": number(named.get("WARC-Record-ID")),
        "url": named.get("WARC-Target-URI"),
        "record_type": named["WARC-Type"],
        "refers_to": number(named.get("WARC-Refers-To")),
        "payload": None if revisit else payload,
        "payload_bytes": int(length[1]) if revisit and length else len(payload),
        "payload_digest": named.get("WARC-Payload-Digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload),
    }


def records(file, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end)."""
    source = Source(file, start)
    while source.at < end:
        found = source.find(MAGIC)
        if found < 0:
            source.forget(max(0, source.left() - len(MAGIC) + 1))
            if not source.more():
                return
            continue
        source.forget(found)
        if source.at >= end:
            return
        got = member(source)
        fields = got and parse(got[0])
        if fields:
            yield fields
        source.forget(got[1] if fields else 1)


FIELDS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
])


def read_warc(files: DataFrame, *, span: int = RANGE, fields: tuple[str, ...] = tuple(FIELDS.names)) -> DataFrame:
    """The records of files (path, bytes), as tasks find them in ranges of `span` bytes.

    fields names the columns that are wanted. payload is null for revisits;
    bytes and digest are the full payload's always, digests of responses are
    computed from what was read. What lies between records, and members that
    are no WARC records, is passed over. Files without bytes give nothing.
    """
    schema = T.StructType([FIELDS[f] for f in fields])
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(span))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as file:
                    some, size = [], 0
                    for x in records(file, start, start + span):
                        some.append({f: x[f] for f in fields})
                        size += x["payload_bytes"] if "payload" in fields else 100
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(some, schema=arrow)
                            some, size = [], 0
                    yield pa.RecordBatch.from_pylist(some, schema=arrow)

    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    arrow = pa.schema([(f.name, kinds[f.dataType]) for f in schema])
    # A range is a small row and much work: with a number of its own, Spark doesn't lay the small partitions together.
    tasks = min(TASKS, files.agg(F.sum(F.ceil(F.col("bytes") / span))).first()[0] or 1)
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, schema)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the files in a folder, as Spark lists them; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))


#: Base32 takes five bits a letter: letter i lies in the hexadecimal digits from 5 * i // 4 on, two of which hold it whole.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), g AS (SELECT *, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INT), 1)) - 1)
      // CAST(pow(2, 3 - (5 * i) % 4) AS BIGINT)) % 32 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
