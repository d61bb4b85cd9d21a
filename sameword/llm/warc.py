"""WARC archives through a chunked record table.

write() makes one record of each row; a payload over a chunk (CHUNK bytes) becomes a response and its continuation records (the
format's segments), so that each row that Spark's text sink gets is one whole record of bounded size. read_chunks() streams
archives back line by line into rows of (record_id, chunk_no): a task keeps one chunk and one running digest, never a
record, however long it is. Each segment carries the digest of the payload up to its end, which the reader checks on the way.

Of records with equal payloads the one with the smallest identifier is written whole; the others are revisits of it.

Defined cases: a null payload is an empty one; a null identifier sorts last and is read back as null; of rows with one
identifier and payload the first in file order is the response; a null address has no WARC-Target-URI; control characters
and spaces in an address are percent-encoded for good, those of an identifier are decoded again; an empty table gives
archives without records; other columns, whatever their names, are not written. Archives are gzip files of any number of
members. A line of a foreign archive (bytes without CRLF) must fit in a row of Spark's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import small_batches
from sameword.llm.exact_dedup import SALTS
from sameword.llm.locate import with_locator
from sameword.operators.sieve import flagged
from sameword.shared import fresh_path, stage

#: Bytes of a chunk, and of the rows that a task hands on at once.
CHUNK, AT_ONCE = 1 << 20, 1 << 22
DATE = "2024-01-01T00:00:00Z"
EOL = b"\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
CHUNKS = "record_id string, record_type string, uri string, identifier string, refers_to string, refers_identifier string, chunk_no int, offset bigint, size bigint, payload_bytes bigint, payload_digest string, last boolean, sound boolean, body binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(file: int, row: int) -> str:
    """A row's name, made of its locator."""
    return f"<urn:uuid:{uuid.UUID(int=((file & (1 << 64) - 1) << 64) | (row & (1 << 64) - 1))}>"


def safe(value: str | None, more: str = "") -> str | None:
    """A header value on one line."""
    return None if value is None else re.sub(rf"[\x00-\x20\x7f{more}]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: dict[str, object], *block: bytes) -> bytes:
    """A record but for its last line end, which the text sink adds."""
    fields = fields | {"Content-Length": sum(map(len, block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"".join((f"{VERSION}\r\n{head}\r\n".encode(), *block, EOL))


def response(own: str, shared: dict[str, object], payload: memoryview, chunk: int) -> Iterator[bytes]:
    """The records of one payload: a response, and continuations where it is longer than a chunk. Each has the digest of
    the payload so far."""
    count, run = max(1, -(-len(payload) // chunk)), hashlib.sha1()
    head = HTTP.format(len(payload)).encode()
    whole = f"sha1:{base32(hashlib.sha1(payload).digest())}"
    for k in range(count):
        piece = payload[k * chunk : (k + 1) * chunk]
        run.update(piece)
        so_far = {"X-Payload-Digest-So-Far": f"sha1:{base32(run.digest())}"}
        if k == 0:
            more = {"WARC-Segment-Number": 1} if count > 1 else {}
            yield record({"WARC-Type": "response", "WARC-Record-ID": own, **shared, "WARC-Payload-Digest": whole, "Content-Type": "application/http; msgtype=response", **more, **so_far}, head, piece)
        else:
            name = f"<urn:uuid:{uuid.uuid5(uuid.UUID(own[10:-1]), str(k))}>"
            total = {"WARC-Segment-Total-Length": len(head) + len(payload)} if k == count - 1 else {}
            yield record({"WARC-Type": "continuation", "WARC-Record-ID": name, "WARC-Date": shared["WARC-Date"], "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k + 1, **total, **so_far}, piece)


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """Of rows (id, name, uri, file, row, payload) those whose payload, of at least `least` bytes, a row before them has:
    name, uri, file, row, size, sha, and that row as `first`. Equal means an equal SHA-256; payloads don't move."""
    size = F.octet_length("payload").cast("bigint")
    held = stage(rows.where(size >= least).select("id", "name", "uri", "file", "row", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha"), size.alias("size")), "warc-digests")
    earliest = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "file", "row", "name"))
    first = held.groupBy("key").agg(earliest.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # copies of one payload meet their first in SALTS parts
    salted = held.drop("id").withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.lit(SALTS)))
    parted = salted.select("key", "salt").distinct().join(first.hint("merge"), "key")
    met = salted.join(parted.hint("merge"), ["key", "salt"])
    return met.where((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row"))).drop("key", "salt")


def write(docs: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, date: str = DATE, chunk: int = CHUNK) -> None:
    """Write archives of gzip files into a new folder; each is what one task writes. Only rows that may be revisits, by a
    bitmap of 1 MB, are joined; the others go from the scan to the sink."""
    small_batches(docs.sparkSession)
    at = with_locator(docs.select(F.col(id_col), F.col(uri_col), F.col(payload_col)))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = at.rows.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(uri_col).alias("uri"), F.col(at.file).alias("file"), F.col(at.row).alias("row"), payload.alias("payload"))
    again = stage(revisits(rows, least), "warc-revisits")
    seen = flagged(rows, again, "maybe", "file", "row")
    apart = seen.where("maybe").join(again.select("file", "row"), ["file", "row"], "left_anti")
    whole = seen.where("not maybe").unionByName(apart).select("name", "uri", "file", "row", "payload")
    later = again.select("name", "uri", "file", "row", "size", "sha", F.col("first.file").alias("first_file"), F.col("first.row").alias("first_row"), F.col("first.name").alias("first_name"))

    def shared(name: str | None, uri: str | None) -> dict[str, object]:
        return {"WARC-Date": date, "WARC-Target-URI": safe(uri), "X-Identifier": safe(name, "%")}

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for name, uri, file, row, body in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                for one in response(record_id(file, row), shared(name, uri), memoryview(body.as_buffer()), chunk):
                    made.append(one)
                    size += len(one)
                    if size >= AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                        made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, uri, file, row, size, sha, first_file, first_row, first_name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(first_file, first_row), "X-Refers-To-Identifier": safe(first_name, "%")}
                digest = {"WARC-Payload-Digest": f"sha1:{base32(bytes.fromhex(sha))}", "X-Payload-Length": size}
                made.append(record({"WARC-Type": "revisit", "WARC-Record-ID": record_id(file, row), **shared(name, uri), **refers, **digest}))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    records = whole.mapInArrow(responses, "record binary").unionByName(later.mapInArrow(repeats, "record binary"))
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", EOL.decode()).text(path)


class Reader:
    """Records of one archive after the other, from its lines. What it holds is a record's head and the lines of a chunk."""

    def __init__(self, bodies: bool, chunk: int):
        self.bodies, self.size, self.out, self.file = bodies, chunk, [], None
        self.head: list[bytes] = []
        self.state = "between"
        self.origin: dict | None = None

    def fail(self, what: str):
        raise ValueError(f"no archive as the format has it: {what}")

    def close(self) -> None:
        if self.state != "between" or (self.origin and self.origin["open"]):
            self.fail("it ends within a record")

    def line(self, file: int, text: bytes) -> None:
        if file != self.file:
            self.close()
            self.file, self.origin = file, None
        if self.state == "block":
            self.block(text)
        elif self.state == "head":
            if text:
                self.head.append(text)
            else:
                self.begin()
        elif text:  # between records, empty lines are line ends of the one before
            if not text.startswith(b"WARC/"):
                self.fail("a record begins with another line than its version")
            self.state, self.head = "head", []

    def begin(self) -> None:
        lines = "\n".join(x.decode("utf-8", "replace") for x in self.head)
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in re.sub(r"\n[ \t]+", " ", lines).split("\n"))}
        kind, own = fields.get("warc-type", ""), fields.get("warc-record-id", "")
        self.left = int(fields.get("content-length", "0"))
        if kind == "continuation":
            o = self.origin
            if o is None or fields.get("warc-segment-origin-id") != o["record_id"] or int(fields.get("warc-segment-number", "0")) != o["segment"] + 1:
                self.fail(f"{own} doesn't follow the segment before it")
            o["segment"] += 1
            o["open"] = "warc-segment-total-length" not in fields
        else:
            if self.origin and self.origin["open"]:
                self.fail(f"{self.origin['record_id']} lacks its last segment")
            named = {k: (None if (v := fields.get(f)) is None else unquote(v)) for k, f in (("identifier", "x-identifier"), ("refers_identifier", "x-refers-to-identifier"))}
            o = {"record_id": own, "record_type": kind, "uri": fields.get("warc-target-uri"), **named, "refers_to": fields.get("warc-refers-to")}
            o |= {"digest": hashlib.sha1(), "offset": 0, "chunk_no": 0, "sound": True, "segment": 1, "open": fields.get("warc-segment-number") == "1", "told": fields}
            self.origin = o
        o["so_far"] = fields.get("x-payload-digest-so-far")
        self.in_http = kind == "response" and fields.get("content-type", "").lower().startswith("application/http")
        self.parts: list[bytes] = []
        self.held, self.state = 0, "block"
        if self.left == 0:
            self.finish()

    def block(self, text: bytes) -> None:
        more = min(self.left - len(text), len(EOL))  # the line end is the block's own, or the record's
        if more < 0 or more == 1:
            self.fail(f"the length of {self.origin['record_id']} is another one than it says")
        self.left -= len(text) + more
        if self.in_http:
            self.in_http = text != b""
        else:
            self.parts.append(text if more == 0 else text + EOL)
            self.held += len(text) + more
            if self.held >= self.size and self.left:
                self.chunk(False)
        if self.left == 0:
            self.finish()

    def finish(self) -> None:
        self.state = "between"
        if not self.origin["open"] or self.held:
            self.chunk(not self.origin["open"])

    def chunk(self, last: bool) -> None:
        o, body = self.origin, b"".join(self.parts)
        o["digest"].update(body)
        told, digest, size = o["told"], base32(o["digest"].digest()), o["offset"] + len(body)
        if self.left == 0 and o["so_far"]:
            o["sound"] &= o["so_far"] == f"sha1:{digest}"
        if o["record_type"] == "revisit":
            size, digest = int(told.get("x-payload-length", "0")), told.get("warc-payload-digest", "").removeprefix("sha1:")
        elif last and "warc-payload-digest" in told:
            o["sound"] &= told["warc-payload-digest"] == f"sha1:{digest}"
        self.out.append((o["record_id"], o["record_type"], o["uri"], o["identifier"], o["refers_to"], o["refers_identifier"], o["chunk_no"], o["offset"], len(body), size, digest, last, o["sound"], body if self.bodies else None))
        o["offset"] += len(body)
        o["chunk_no"] += 1
        self.parts, self.held = [], 0


def read_chunks(spark: SparkSession, path: str, bodies: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in a folder. payload_bytes and payload_digest (bare SHA-1 in base 32) are those of the
    payload up to the chunk's end, and so of all of it in the `last` one; a revisit has one chunk without bytes, and what
    its record says of the payload it stands for. sound: so far, digests are as the records say."""
    schema = spark.createDataFrame([], CHUNKS).schema
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, size = Reader(bodies, chunk), 0

        def made() -> pa.RecordBatch:
            rows, reader.out = reader.out, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], schema.names)

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader.line(file, text)
                size += len(text)
                if size >= AT_ONCE:
                    yield made()
                    size = 0
        reader.close()
        yield made()

    small_batches(spark)
    lines = spark.read.option("lineSep", EOL.decode()).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, schema)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: its last chunk's, without the bytes."""
    return chunks.where("last").drop("body", "chunk_no", "offset", "size", "last")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = records(read_chunks(spark, path, bodies=False))
    return found.select(F.col("identifier").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_identifier").cast("bigint").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
