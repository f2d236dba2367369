"""WARC archives with resolved revisits.

Payload headers (id, length, SHA-1) are grouped by digest to find each payload's
original response; the others become revisit records that refer to it. Records are
composed by Spark expressions and written as text files whose row separator is the
blank line pair that ends a WARC record; reading takes whole files and goes by each
record's Content-Length, so payloads may hold anything.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Payloads below this many bytes are always written in full.
REVISIT_BYTES = 1000
#: Bytes of payload in one archive file at most (or one record): a file is read as a
#: whole. Records of up to _SMALL bytes share files, larger ones those of their size.
FILE_BYTES, _SMALL = 64 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "record_id string, record_type string, refers_to string, digest string, target_uri string, payload binary"


def _field(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\\r\\n]+", "%0A")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def resolved(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, original: the page_id
    of the response that a revisit refers to, null where the row itself is a response."""
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long_ = F.octet_length("payload") >= revisit_bytes
    heads = rows.where(long_).select("digest", "page_id")
    originals = heads.groupBy("digest").agg(F.max("page_id").alias("__original"), F.count("*").alias("__n")).where("__n > 1").select("digest", "__original")
    # what cannot be a revisit meets nothing, and is spread instead of met by its digest
    alone = F.concat(F.lit("alone "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))
    joined = rows.withColumn("__key", F.when(long_, F.col("digest")).otherwise(alone)).join(originals.withColumnRenamed("digest", "__key").hint("merge"), "__key", "left")
    original = F.when(long_ & ((F.col("page_id") != F.col("__original")) | F.col("page_id").isNull()), F.col("__original"))
    return joined.select("page_id", "url", "payload", "digest", original.alias("original"))


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """resolved rows -> (record): whole WARC records without their closing blank lines
    (and the file that they go to, if rows name it)."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _field(F.col("url")),
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("original")))).otherwise(F.lit("")),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
            F.lit("\r\n\r\n"), F.col("block"),
        ).alias("record"),
        *[c for c in rows.columns if c == "file"],
    )


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write one record for each row of pages into gzipped archives below path.

    Of equal payloads of at least revisit_bytes the row with the largest page_id is the
    response and the others are revisits (rows that share that page_id are responses
    all; null page_ids are revisits unless all are null). Null html: an empty payload.
    Null url: an empty target. No rows: no records."""
    rows = resolved(pages, revisit_bytes)
    size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.octet_length("payload"), F.lit(_SMALL)))))
    at_once = F.greatest(F.lit(1), F.floor(F.lit(FILE_BYTES) / size))
    # a row's number in its task (the low 33 bits), cut by how many of its size fill a file
    in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    file = F.concat_ws("-", size.cast("long"), F.floor(in_task / at_once).cast("long"))
    out = records(rows.withColumn("file", file)).select("record", "file")
    out.write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records below path: record_id, record_type, refers_to, digest, target_uri, and
    payload (the entity after the HTTP headers; empty for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, rows, size = gzip.decompress(content.as_py()), [], 0
                at, end = 0, len(data)
                while at < end:
                    stop = data.index(b"\r\n\r\n", at)
                    lines = data[at:stop].split(b"\r\n")
                    head = {k.lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
                    n = int(head["content-length"])
                    block = data[stop + 4 : stop + 4 + n]
                    cut = block.find(b"\r\n\r\n") + 4
                    rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-target-uri"], block[cut:]))
                    size += n
                    at = stop + 4 + n + 4
                    if size > 8 << 20 or at >= end:
                        cols = list(zip(*rows, strict=True))
                        kinds = [pa.string()] * 5 + [pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["record_id", "record_type", "refers_to", "digest", "target_uri", "payload"])
                        rows, size = [], 0

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _READ)


def catalog_of(archives: DataFrame) -> DataFrame:
    """read_archives rows -> page_id, payload_bytes, payload_digest, record_type,
    refers_to: the digest is computed from what was read, a revisit's length and digest
    come from the response that it is joined to. The archives are read once."""
    own = archives.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, 'urn:page:(-?[0-9]+)', 1), '') as long)").alias("page_id"),
        "record_type",
        F.expr("try_cast(nullif(regexp_extract(refers_to, 'urn:page:(-?[0-9]+)', 1), '') as long)").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("n"),
        F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
    )
    own = cut(own)
    responses = own.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(F.max("n").alias("__n"))
    out = own.join(responses.hint("merge"), (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    return out.select("page_id", F.coalesce("__n", "n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
