"""WARC archives of captures, and their transactions put together again.

Writing: a capture is a request, a response or revisit, and a metadata record; the other two kinds name the response's
record id in WARC-Concurrent-To, and a revisit names that of its response in WARC-Refers-To.  Of captures with equal
payloads the one with the largest page_id is the response, the others revisit it; payloads are compared by SHA-1 digest
and length.  The records are strings made by built-in expressions; each is compressed to a gzip member of its own, as
WARC readers expect, and Spark's text writer puts the members into files of at most RECORDS_PER_FILE records, and never
more than a task's split, in the shared folder.  Payloads go from scan to file without a shuffle; only (row, digest)
pairs are shuffled, and a hot digest is reduced to its largest page_id before.

The text writer ends each value with a separator.  It is the byte zero, which is the last one of a gzip member below
16 MB (the high byte of its length); so a member is handed over without it.  A longer one is followed by an empty member.

Reading: a task takes an archive at a time, unpacks it as a stream and yields its records.  A response's digest and length
are those of the payload that was read; an archive whose header says another digest is refused.

Defined cases: a null html is an empty payload; repeated rows are captures of their own, of which one is the response; a
null page_id is less than any other; an empty table gives no archive and no captures; other columns are not read.  A url
with line breaks is written with them percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.shared import materialise, new_path

RECORDS_PER_FILE = 50_000
LEVEL = 3
CRLF = "\r\n"
FIELDS = "page_id long, kind string, record_id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload binary"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 digest in hexadecimal: 32 characters, each of 5 of its 160 bits."""
    # 5 hexadecimal digits are 20 bits and so 4 characters.
    chunk = lambda k: F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
    return F.concat(*[F.substr(F.lit(ALPHABET), F.shiftright(chunk(k), shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(8) for shift in (15, 10, 5, 0)])


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]], F.lit(">"))


def assign(pages: DataFrame) -> DataFrame:
    """Rows with __row, page_id, url, html, digest, n_bytes, first (the row that responds) and its page_id."""
    rows = pages.select(F.monotonically_increasing_id().alias("__row"), "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n_bytes", F.octet_length("html").cast("long"))


def write(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write the archives; their folder."""
    spark = pages.sparkSession
    rows = assign(pages)
    best = F.max(F.struct("page_id", "__row"))
    keys = materialise(rows.select("digest", "n_bytes", "page_id", "__row"), "warc-digests")
    repeated = keys.groupBy("digest", "n_bytes").agg(best.alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = keys.join(repeated, ["digest", "n_bytes"]).filter(F.col("first.__row") != F.col("__row")).select("__row", F.col("first.__row").alias("first_row"), F.col("first.page_id").alias("first_id"))
    revisits = materialise(revisits, "warc-revisits")
    # A narrow join if revisits are few; otherwise the pages go through a shuffle once.
    rows = rows.join(F.broadcast(revisits) if revisits.count() <= 1_000_000 else revisits, "__row", "left")
    revisit = F.col("first_row").isNotNull()
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    key, page = F.col("__row").cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    response_id = _uuid(F.lit("response"), page, key)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def record(kind: Column, rid: Column, block: Column, mime: str, *more: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", rid), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri), line("X-Page-ID", page),
            *more, line("Content-Type", F.lit(mime)), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF * 2),
        )

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("n_bytes").cast("string")), F.lit(CRLF))
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest"))))
    refers = F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _uuid(F.lit("response"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.col("first_row").cast("string"))))).otherwise("")
    together = line("WARC-Concurrent-To", response_id)
    host = F.regexp_extract(uri, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_replace(F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*", "")
    request = F.concat(F.lit("GET "), F.when(target.startswith("/"), "").otherwise("/"), F.regexp_replace(target, " ", "%20"), F.lit(f" HTTP/1.1{CRLF}"), line("Host", host), F.lit(CRLF))
    records = F.array(
        record(F.lit("request"), _uuid(F.lit("request"), page, key), request, "application/http; msgtype=request", together),
        record(F.when(revisit, "revisit").otherwise("response"), response_id, F.when(revisit, http).otherwise(F.concat(http, "html")), "application/http; msgtype=response", digest, refers),
        record(F.lit("metadata"), _uuid(F.lit("metadata"), page, key), F.lit(f"fetchTimeMs: 0{CRLF}"), "application/warc-fields", together),
    )
    path = new_path(spark, "warc")
    members = rows.select(F.explode(records).alias("record")).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is zero."""
    empty = gzip.compress(b"", mtime=0)
    for b in batches:
        out, size = [], 0
        for record in b.column(0):
            member = gzip.compress(record.as_buffer(), LEVEL, mtime=0)
            out.append((member if member[-1] == 0 else member + empty)[:-1])
            size += len(out[-1])
            if size > 1 << 24:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])
                out, size = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])


def _stream(content: bytes) -> io.BufferedReader:
    class Unpack(io.RawIOBase):
        def __init__(self):
            self.z, self.at, self.left = zlib.decompressobj(31), 0, b""

        def readable(self):
            return True

        def readinto(self, buffer):
            while not self.left:
                if self.z.eof:
                    self.at -= len(self.z.unused_data)
                    self.z = zlib.decompressobj(31)
                if self.at >= len(content):
                    return 0
                part = content[self.at : self.at + (1 << 16)]
                self.at += len(part)
                self.left = self.z.decompress(part)
            n = min(len(buffer), len(self.left))
            buffer[:n], self.left = self.left[:n], self.left[n:]
            return n

    return io.BufferedReader(Unpack(), 1 << 16)


def _records(content: bytes) -> Iterator[tuple]:
    """The records of an archive; lengths tell where one ends, empty lines between records are skipped."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        kind, payload, n = head["warc-type"], None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            n = len(payload) if kind == "response" else next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        page = lambda name: int(head[name]) if head.get(name) else None
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, found):
                raise ValueError(f"record {head['warc-record-id']}: the payload's digest is {found}, not {digest}")
            digest = found
        yield page("x-page-id"), kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), digest, n, payload


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives in a folder; without ``payload`` that column is NULL, and digest and length tell of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [f.split()[0] for f in FIELDS.split(", ")]
        make = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in _records(content.as_py()):
                    rows.append(r if payload else (*r[:8], None))
                    size += len(rows[-1][8] or b"")
                    if size > 1 << 24 or len(rows) >= 8192:
                        yield make(rows)
                        rows, size = [], 0
                if rows:
                    yield make(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, FIELDS)


def transactions(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: page_id, and request, response (of kind response or revisit) and metadata as structs.

    The three kinds meet by the response's record id, of which there is one per capture, so no key is hot.
    """
    main = records.filter(F.col("kind").isin("response", "revisit"))
    fields = [c for c in records.columns if payload or c != "payload"]
    side = lambda kind: records.filter(F.col("kind") == kind).select(F.col("concurrent_to").alias("to"), F.struct("record_id", "uri").alias(kind))
    sides = side("request").unionByName(side("metadata"), allowMissingColumns=True).groupBy("to").agg(F.first("request", ignorenulls=True).alias("request"), F.first("metadata", ignorenulls=True).alias("metadata"))
    return main.join(sides, main["record_id"] == sides["to"], "left").select("page_id", F.struct(*fields).alias("response"), "request", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """captures with refers_to: the page_id of the response whose record id a revisit names, null for responses.

    Responses have a row each, so that a response with very many revisits makes one side of the join large only, which
    adaptive execution splits.
    """
    responses = captures.filter(F.col("response.kind") == "response").select(F.col("response.record_id").alias("__id"), F.col("page_id").alias("refers_to"))
    return captures.join(responses, captures["response"]["refers_to"] == responses["__id"], "left").drop("__id")
