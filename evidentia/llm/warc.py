r"""Content-addressed web archive: payload bytes once by SHA-256, record headers apart, records rebuilt by a join.

An archive is a folder with two Parquet tables: `payloads` (key, payload, slices) and `headers` (key, slice, header),
where header holds the exact header lines of a WARC 1.1 record. A record is its header, an empty line, its payload
(none for a revisit) and two line ends. A payload of very many records meets them in slices, so it is no hot key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: So many records of one payload meet it in one place.
SLICE_RECORDS = 4096
#: Copies of the narrow table of repeated payloads that rows are joined with.
SLICES = 16


def _name(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row of pages.

    Of records with equal payloads of at least least_bytes bytes, those with the largest page_id are responses and
    the others revisit one of them (a null page_id is the smallest; all null: all responses). Smaller payloads are
    always responses. Null payloads are empty, a null url gives no target line, line ends in a url are
    percent-encoded. Repeated rows make a record each; a record's id has a running number besides its page_id, so
    that null and repeated page ids give no two records one id. Other columns are ignored.
    """
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("page_id", "url", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"), "payload")
    slices = F.ceil(F.count("*") / SLICE_RECORDS).cast("int").alias("slices")
    rows.groupBy("key").agg(F.first("payload").alias("payload"), slices).write.parquet(f"{path}/payloads")
    small = materialize(rows.drop("payload").withColumn("number", F.monotonically_increasing_id()), "warc-rows")
    first = F.max(F.when(F.col("bytes") >= least_bytes, F.struct("page_id", "number")))
    repeated = small.groupBy("key").agg(F.count("*").alias("n"), first.alias("first"), slices).where("n > 1").drop("n")
    repeated = repeated.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    marked = small.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(SLICES)).cast("int")).join(repeated, ["key", "part"], "left")
    again = F.coalesce(F.col("page_id") != F.col("first.page_id"), F.col("first.page_id").isNotNull() & F.col("page_id").isNull())
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("page_id"), F.col("number"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first.page_id"), F.col("first.number")))),
        F.when(again, F.lit(f"WARC-Profile: {_REVISIT}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("bytes"))),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n")).alias("header")
    marked.select("key", F.pmod(F.xxhash64("number", F.lit(1)), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"), header).write.parquet(f"{path}/headers")


def _line(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def records(spark: SparkSession, path: str) -> DataFrame:
    """key, record, stored: the exact bytes of every record of an archive, and the payload its header's digest stands for.

    The digest of every stored payload is computed again and must be its key; otherwise the read fails.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.when(F.sha2("payload", 256) == F.col("key"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("key"))))
    stored = stored.select(right.alias("key"), F.col("payload").alias("stored"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = spark.read.parquet(f"{path}/headers").join(stored, ["key", "slice"], "left")
    body = F.when(F.col("header").rlike(r"(?m)^WARC-Type: revisit\r?$"), F.lit(b"")).otherwise(F.col("stored"))
    return rows.select("key", F.concat(F.encode("header", "UTF-8"), F.lit(b"\r\n"), body, F.lit(b"\r\n\r\n")).alias("record"), "stored")


def parsed(rows: DataFrame) -> DataFrame:
    """rows of records() with what their bytes say: page_id, url, record_type, refers_to, header, body, payload, payload_bytes, payload_digest.

    The body is as long as the header's Content-Length and must be followed by two line ends; the payload (the body,
    or for a revisit what is stored under its digest) must have the header's SHA-1; otherwise the read fails.
    """
    rows = rows.withColumn("head", F.concat(F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1), F.lit("\r\n")))
    start = F.octet_length("head") + 2
    length = _line("Content-Length").cast("int")
    rows = rows.withColumn("body", F.col("record").substr(start + 1, length)).withColumn("tail", F.col("record").substr(start + length + 1, F.lit(2**31 - 1)))
    rows = rows.withColumn("record_type", _line("WARC-Type"))
    payload = F.when(F.col("record_type") == "revisit", F.col("stored")).otherwise(F.col("body"))
    rows = rows.withColumn("payload", F.when(F.col("tail") == F.lit(b"\r\n\r\n"), payload).otherwise(F.raise_error(F.concat(F.lit("broken record "), F.col("head")))))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:x-page:(-?\d*):\d+>$", 1), F.lit("")).cast("long")
    digest = F.when(F.concat(F.lit("sha1:"), F.col("sha1")) == _line("WARC-Payload-Digest"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("head"))))
    return rows.select(
        page(_line("WARC-Record-ID")).alias("page_id"),
        _line("WARC-Record-ID").alias("record_id"),
        _line("WARC-Target-URI").alias("url"),
        "record_type",
        page(F.coalesce(_line("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
        F.col("head").alias("header"),
        "record",
        "body",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive, rebuilt to its bytes and read from them; see parsed()."""
    return parsed(records(spark, path))


def archive_path(folder: str) -> str:
    return f"{folder}/evidentia-warc-{uuid.uuid4().hex}"
