"""Deduplicated WARC archives with resolved revisit records.

Headers alone (id, digest, size) are shuffled by payload digest; the newest record of each digest becomes the
response, and the others refer to it. The archives are written by Spark's own writer, so they reach any store that
Spark reaches: a record ends with CRLF CRLF, which is the writer's separator between rows. Each file holds records
of about ARCHIVE_BYTES, so that a task reads it back whole; a larger record has a file of its own size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table, written

#: Records of smaller payloads are written whole, never as revisits.
LEAST = 0
#: Payload bytes to an archive file.
ARCHIVE_BYTES = 8 << 20
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the payload's digest and size."""
    for b in batches:
        digests, sizes = [], []
        for x in b.column("payload"):
            data = memoryview(x.as_buffer() or b"")
            digests.append(base64.b32encode(hashlib.sha1(data).digest()).decode())
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=[*b.schema.names, "digest", "size"])


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, digest, size, uri) with record_type, refers_to and refers_uri: the largest id of a digest is the response.

    Only the newest id of each digest is summed up, which combines before the shuffle, so a digest that a third
    of all records share costs no more than any other; the join back has one row a digest on one side. Records
    with a null id are always responses, and so are those smaller than `least`. Of rows that repeat an id with
    the same digest, one can't be told from the other: all of them are responses.
    """
    newest = headers.filter((F.col("size") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("newest"), F.max_by("uri", "id").alias("newest_uri"))
    joined = headers.join(newest, "digest", "left")
    revisit = (F.col("size") >= least) & F.col("id").isNotNull() & (F.col("newest") != F.col("id"))
    kind = F.when(F.coalesce(revisit, F.lit(False)), F.lit("revisit")).otherwise(F.lit("response"))
    joined = joined.withColumn("record_type", kind)
    again = F.col("record_type") == "revisit"
    return joined.withColumn("refers_to", F.when(again, F.col("newest"))).withColumn("refers_uri", F.when(again, F.col("newest_uri"))).drop("newest", "newest_uri")


def _urn(c: Column) -> Column:
    """A record id that is a function of the record's own id, so that a rerun writes the same archives."""
    h = F.md5(F.concat(F.lit("record/"), c.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """One column `record` (binary) of rows(id, uri, date, payload, digest, size, record_type, refers_to, refers_uri): header block and body."""
    revisit = F.col("record_type") == "revisit"
    one_line = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]", "")
    date = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")  # one capture has one date
    # the id line is this writer's own header; readers of other archives don't need it
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.coalesce(F.col("id").cast("string"), F.lit("null")))),
        F.concat(F.lit("X-Source-ID: "), F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Target-URI: "), one_line("uri")),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to").cast("string")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), one_line("refers_uri"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), date)),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Source-ID: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/octet-stream"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(CRLF),
    ]
    head = F.concat_ws(CRLF, *lines).cast("binary")
    return rows.select(F.concat(head, F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))).alias("record"))


def write_archives(rows: DataFrame, path: str) -> None:
    """Writes rows (see records) below path: a file for each partition, .txt.gz by name and compressed WARC 1.1 by content."""
    # the bytes go through Spark's text writer as they are; it checks no encoding
    records(rows).select(F.col("record").cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case, the first line under '') and bodies of an archive's records, uncompressed."""
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"byte {at}: a record's header doesn't end")
        first, *lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"byte {at}: no record begins here")
        head = {"": first}
        for line in lines:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        at = end + 4 + size
        if at + 4 > len(data) or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"byte {at}: the record of {size} bytes doesn't end with an empty line")
        yield head, view[end + 4 : end + 4 + size]
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below path: id, uri, record_type, digest, size, refers_to (as text) and payload."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["id", "uri", "record_type", "digest", "size", "refers_to", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for x in b.column(0):
                rows, held = [], 0
                for head, body in parse(gzip.decompress(x.as_buffer())):
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((head.get("x-source-id") or None, head.get("warc-target-uri"), head["warc-type"], digest, int(head.get("x-payload-length", len(body))), head.get("x-refers-to-source-id"), bytes(body)))
                    held += len(body)
                    if held > ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, "id string, uri string, record_type string, digest string, size long, refers_to string, payload binary")


def _inspected(back: DataFrame) -> DataFrame:
    """(id, record_type, refers_to, declared, digest, size) of read_archives(): what the headers declare, and what the bodies are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _hash(batches):
            yield b.select(["id", "record_type", "refers_to", "declared", "digest", "size"])

    slim = back.select("id", "record_type", "refers_to", F.col("digest").alias("declared"), "payload")
    return slim.mapInArrow(run, "id string, record_type string, refers_to string, declared string, digest string, size long")


def resolved(back: DataFrame) -> DataFrame:
    """(id, record_type, refers_to, declared, digest, size, intact) of the records of read_archives().

    digest and size are of the payload as it was read: a response's own, and for a revisit those of the response
    that it refers to, if that was read; else they are null. intact: the digest is the one that the record's header
    declares. A response's facts are joined to the revisits without payloads.
    """
    seen = written(_inspected(back), "warc-read")
    whole = seen.filter("record_type = 'response'")
    facts = whole.filter("id is not null").select(F.col("id").alias("refers_to"), F.col("digest").alias("declared"), F.col("digest").alias("found"), F.col("size").alias("found_size")).distinct()
    again = seen.filter("record_type = 'revisit'").join(facts, ["refers_to", "declared"], "left")
    again = again.select("id", "record_type", "refers_to", "declared", F.col("found").alias("digest"), F.col("found_size").alias("size"))
    both = whole.select("id", "record_type", "refers_to", "declared", "digest", "size").union(again)
    return both.withColumn("intact", F.coalesce(F.col("digest") == F.col("declared"), F.lit(False)))


def restored(back: DataFrame) -> DataFrame:
    """read_archives() with each revisit's payload taken from the response that it refers to; null where that is missing."""
    whole = back.filter("record_type = 'response'")
    known = whole.filter("id is not null").select(F.col("id").alias("refers_to"), "digest", "payload").dropDuplicates(["refers_to", "digest"])
    again = back.filter("record_type = 'revisit'").drop("payload").join(known, ["refers_to", "digest"], "left")
    return whole.unionByName(again.select(*back.columns))


def deduplicated(pages: DataFrame, path: str, id_col: str, uri_col: str, payload_col: str, date: str = "2024-01-01 00:00:00", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of pages to archives below path; returns them as read back from there.

    Null payloads are empty; a null id gives a response without an id; repeated rows each give a record. Other
    columns are left out. All records of a call have one date, that of the capture. A file is one gzip member, as
    Spark's text writer makes it: a record is found by reading its file, not by an offset. The payloads take one shuffle, to their archives; what decides their kind takes its own,
    of headers.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{uri_col}`").alias("uri"), payload.alias("payload"))
    hashed = base.mapInArrow(_hash, f"id {dict(base.dtypes)['id']}, uri string, payload binary, digest string, size long")
    headers = written(hashed.select("id", "digest", "size", "uri"), "warc-headers")
    revisits = resolve(headers, least).filter("record_type = 'revisit'").select("id", "digest", "refers_to", "refers_uri").distinct()
    stored = headers.groupBy("digest").agg(F.max("size").alias("size")).agg(F.sum("size")).first()[0] or 0
    # dealt by record, not by digest: equal payloads don't meet in one task
    dealt = hashed.repartition(max(1, -(-int(stored) // archive_bytes)), "id", "digest")
    rows = dealt.join(revisits, ["id", "digest"], "left").withColumn("date", F.lit(date).cast("timestamp"))
    write_archives(rows.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))), path)
    return read_archives(spark, path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; sizes and digests are of the payloads that were read, a revisit's of the response that it refers to."""
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    found = resolved(deduplicated(pages, shared_path(spark, "warc"), "page_id", "url", "html"))
    return found.select(
        F.col("id").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact"
    )
