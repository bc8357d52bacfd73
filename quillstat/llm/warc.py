"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm._tables import new_path, small, store

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``path``/payloads (digest, payload) and ``path``/headers (id, digest, header bytes).

    The digest is SHA-256 with the length. Of records with equal payloads of at
    least ``min_bytes`` bytes the one with the least id is the response, others
    are revisits that refer to it; smaller payloads are all responses. Every
    payload is stored once either way. A null payload is empty, a null id or url
    writes an empty field (a null id is greater than any other). Rows that repeat the least id
    are all responses. Other columns are ignored.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    keyed = base.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.concat(F.sha2("payload", 256), F.lit("-"), F.col("bytes")))
    meta = store(keyed.select("id", "url", "bytes", "digest", base32_sha1(F.col("payload")).alias("sha1")), "warc-meta")
    first = store(meta.groupBy("digest").agg(F.min("id").alias("first_id")), "warc-first")
    holders = small(first.select(F.col("digest").alias("d"), F.col("first_id").alias("f")))
    stored = keyed.select("id", "digest", "payload").join(holders, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("f")), "left_semi")
    repeated = not meta.groupBy("digest", "id").count().where("count > 1").isEmpty()
    stored = stored.select("digest", "payload")
    (stored.dropDuplicates(["digest"]) if repeated else stored).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    meta = meta.join(first, "digest")
    revisit = (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), text(F.col("id")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "%0A")),
        F.lit(f"WARC-Date: {date}"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text(F.col("first_id")), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")
    meta.select("id", "digest", header.alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def read_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, header, payload) of every record, payload rejoined by digest (a revisit's is its response's).

    Fails if a payload is missing or its bytes do not give its digest.
    """
    headers = spark.read.schema(f"id {id_type}, digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads").withColumnRenamed("digest", "stored")
    found = F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload"))
    both = headers.join(payloads, F.col("digest") == F.col("stored"), "left")
    sound = F.when(F.coalesce(found == F.col("digest"), F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("digest"))).cast("binary"))
    return both.select("id", "header", sound.alias("payload"))


def checked_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, header, payload_bytes, payload_sha1) of every record; each stored payload is verified once, and its bytes stay where they are.

    Fails if a payload is missing or its bytes do not give its digest.
    """
    headers = spark.read.schema(f"id {id_type}, digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    found = F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload"))
    checked = payloads.select(F.col("digest").alias("stored"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(found == F.col("digest"), base32_sha1(F.col("payload"))).alias("payload_sha1"))
    both = headers.join(checked, F.col("digest") == F.col("stored"), "left")
    sound = F.when(F.col("payload_sha1").isNotNull(), F.col("payload_sha1")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("digest"))).cast("string"))
    return both.select("id", "header", "payload_bytes", sound.alias("payload_sha1"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(id, record): the exact WARC record, header, block and end; a revisit's block is empty."""
    block = F.when(F.decode("header", "UTF-8").contains("WARC-Type: revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return records.select("id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def field(name: str) -> Column:
    """A field of the record header; null where it has none."""
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), f"(?m)^{name}: ?([^\\r\\n]*)", 1), F.lit(""))


def parsed(records: DataFrame, id_type: str = "long") -> DataFrame:
    """What the archive says of each record: id, payload_bytes, payload_digest, record_type, refers_to; the digest is checked against the payload's.

    Takes the rows of :func:`read_records` or of :func:`checked_records`.
    """
    digest = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    whole = "payload" in records.columns
    own = base32_sha1(F.col("payload")) if whole else F.col("payload_sha1")
    return records.select(
        F.regexp_extract(field("WARC-Record-ID"), "<urn:page:(.*)>", 1).try_cast(id_type).alias("id"),
        F.octet_length("payload").cast("long").alias("payload_bytes") if whole else F.col("payload_bytes"),
        F.when(digest == own, digest).otherwise(F.raise_error(F.lit("payload digest does not match"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(.*)>", 1).try_cast(id_type).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write an archive of pages to the shared folder and parse its records again."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    path = new_path(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes)
    return parsed(checked_records(spark, path, kind), kind).withColumnRenamed("id", id_col)
