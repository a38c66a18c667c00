"""WARC archives: written from a table of pages, read back, and put together into one nested row per capture.

A capture is three records: the request, the response (or the revisit of an earlier response with the same payload) and
metadata. The first and last name the second one in WARC-Concurrent-To. Archives are written by Spark's text writer and
read by its binary file reader, so any store that Spark reaches will do.

Defined cases. A null payload is empty. Equal payloads of at least ``least`` bytes are stored once, under the smallest
key; the others, null keys among them, revisit it, and repeated rows of that smallest key are all responses. If all keys
of a payload are null, all are responses. Line ends in a URL are written as %0D and %0A, a null URL as none. An empty
table writes no records, and an archive without files reads as no records. A record that its file ends within is read
as ``complete = false``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Records of a file at most, and bytes of payload in one Arrow batch.
RECORDS_PER_FILE = 30_000
BATCH_BYTES = 8 << 20


def record_id(kind: str, key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(key.cast("string"), F.lit("null")), digest).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text, without its last line end, which the text writer adds. Null fields are left out."""
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(f"\r\nWARC-Date: {DATE}\r\n"))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> None:
    """Writes the archive of a table of pages to a new folder, gzip files of bounded numbers of records."""
    p = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("body"))
    p = p.withColumns({"digest": F.sha2("body", 256), "n": F.octet_length("body")})
    first = p.filter(F.col("n") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first IS NOT NULL")
    p = p.join(first.select("digest", "first"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    main = F.when(again, record_id("revisit", F.col("key"), F.col("digest"))).otherwise(record_id("response", F.col("key"), F.col("digest")))
    uri = ("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#\r\n]*)", 1)
    records = F.array(
        _record(F.lit("request"), [("WARC-Record-ID", record_id("request", F.col("key"), F.col("digest"))), ("WARC-Concurrent-To", main), uri, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))),
        _record(
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            [("WARC-Record-ID", main), uri, digest, ("WARC-Refers-To", F.when(again, record_id("response", F.col("first"), F.col("digest")))), ("WARC-Profile", F.when(again, F.lit(PROFILE))), ("Content-Type", F.lit("application/http; msgtype=response"))],
            F.concat(F.lit(HTTP_OK), F.when(again, F.lit("")).otherwise(F.col("body"))),
        ),
        _record(F.lit("metadata"), [("WARC-Record-ID", record_id("metadata", F.col("key"), F.col("digest"))), ("WARC-Concurrent-To", main), uri, ("Content-Type", F.lit("application/warc-fields"))], F.coalesce(F.concat(F.lit("key: "), F.col("key").cast("string"), F.lit("\r\n")), F.lit(""))),
    )
    p.select(F.explode(records).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("stated_digest", T.StringType()),
        T.StructField("complete", T.BooleanType(), False),
        T.StructField("payload_bytes", T.LongType(), False),
        T.StructField("payload_digest", T.StringType(), False),
        T.StructField("payload", T.BinaryType(), False),
    ]
)
FIELDS = {b"warc-type": 0, b"warc-record-id": 1, b"warc-concurrent-to": 2, b"warc-refers-to": 3, b"warc-target-uri": 4, b"warc-payload-digest": 5}


def inflate(data: bytes) -> bytes:
    """The bytes of a file of one or many gzip members, or of a plain file."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out) if out else data


def records_of(data: bytes) -> Iterator[tuple]:
    """The records of a file, as rows of RECORD. Of http blocks, the payload is what follows their head."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        row: list = [None] * 6
        length, http = 0, False
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            name, value = name.strip().lower(), value.strip()
            if name in FIELDS:
                row[FIELDS[name]] = value.decode("utf-8", "replace")
            elif name == b"content-length" and value.isdigit():
                length = int(value)
            elif name == b"content-type":
                http = value.lower().startswith(b"application/http")
        block = data[end + 4 : end + 4 + length]
        body = block.partition(b"\r\n\r\n")[2] if http else block
        yield (*row, len(block) == length, len(body), hashlib.sha256(body).hexdigest(), body)
        at = end + 4 + length


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archive in a folder; each task takes whole files."""
    arrow = pa.schema([(f.name, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in parts:
            for content in b.column(0):
                rows, size = [], 0
                for row in records_of(inflate(content.as_py())):
                    rows.append(row)
                    size += row[7]
                    if size >= BATCH_BYTES or len(rows) >= 5000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record, with its request and metadata as nested columns (null where absent).

    Where several requests or metadata records name one capture, the one with the smallest identifier is taken.
    Records that belong to no capture are left out; repeated records of a capture each give a row.
    """
    part = F.struct("record_id", "payload_bytes", "payload", "complete")

    def beside(kind: str) -> DataFrame:
        return records.filter((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(part, "record_id").alias(kind))

    main = records.filter(F.col("type").isin("response", "revisit")).drop("concurrent_to")
    return main.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")


def proved(complete: str, stated: str, computed: str, record: str) -> Column:
    """The computed digest; an error where the record is not complete, or states another one or the digest is missing."""
    good = F.col(complete) & F.coalesce(F.col(stated) == F.concat(F.lit("sha256:"), F.col(computed)), F.col(stated).isNull() & F.col(computed).isNotNull())
    return F.when(good, F.col(computed)).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(record, F.lit("without identifier")))).cast("string"))
