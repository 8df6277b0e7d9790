"""A content-addressed web archive: payloads once, record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.llm.common import folder, narrow, stored

# Digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 160 bits as four groups of 40, each of eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _CONV, _BASE32)


def record_id(page_id: Column) -> Column:
    """A URN made from the page's id, so that a task that runs again writes the same."""
    h = F.md5(page_id.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header(kind: Column, url: Column) -> Column:
    """The exact bytes of a record's header, without its last empty line."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first")))),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(kind == "revisit", F.concat(F.lit("X-Refers-To-Page: "), F.col("first").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit(0)).otherwise(F.col("size")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes ``pages(page_id, url, html)`` as two tables below ``path``.

    ``payloads``: every different payload once, under its SHA-256 and length. ``headers``: the exact header of every record with the key of
    its payload. Among records with equal payloads of at least ``least`` bytes that with the largest ``page_id`` is a response and the others
    revisit it; smaller payloads are responses throughout. Rows that share the largest ``page_id`` are all responses and
    each store their payload, of which reading takes one; a row without ``page_id`` is never
    referred to, and only if no other has its payload is it a response. A null html is empty; other columns are not read.

    Only keys are grouped and joined. Payloads go from the scan to the file: the row that
    answers for its payload writes it, so no group of copies is ever gathered.
    """
    bodies = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    marked = bodies.select("*", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"),
                           F.octet_length("payload").cast("long").alias("size"))
    keys = marked.drop("payload")
    groups = keys.groupBy("sha256", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = groups.filter("n > 1")
    revisit = (F.col("n").isNotNull() & (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    headers = keys.join(shared, ["sha256", "size"], "left").withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
    headers.select("sha256", "size", _header(F.col("kind"), F.col("url")).cast("binary").alias("header")).write.parquet(f"{path}/headers")
    # Copies that are not the first of their payload leave it out.
    left_out = stored(keys.join(shared, ["sha256", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
                      .select(F.col("page_id").alias("p"), F.col("sha256").alias("s")).distinct())
    kept = marked.select("page_id", "sha256", "size", "payload").join(
        narrow(left_out),
        F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha256") == F.col("s")), "left_anti")
    kept.select("sha256", "size", "payload").write.parquet(f"{path}/payloads")


def read_payloads(spark, path: str) -> DataFrame:
    """Stored payloads, each read and checked against its digest and length; a wrong one raises an error."""
    payloads = spark.read.parquet(f"{path}/payloads")
    wrong = (F.sha2("payload", 256) != F.col("sha256")) | (F.octet_length("payload") != F.col("size"))
    return payloads.withColumn("payload", F.when(wrong, F.raise_error(F.concat(F.lit("payload differs from its digest "), "sha256"))).otherwise(F.col("payload")))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"(?md)^{name}: ([^\r\n]*)\r$", 1), F.lit(""))


def read_headers(spark, path: str) -> DataFrame:
    """Records as their headers tell: ``page_id, record_type, refers_to, payload_digest`` and the payload's key."""
    headers = spark.read.parquet(f"{path}/headers")
    return headers.select(
        "sha256", "size", "header", _field("X-Page-ID").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page").cast("long").alias("refers_to"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"))


def records(spark, path: str) -> DataFrame:
    """The original records, rebuilt: header, empty line, payload (none in a revisit) and the closing empty lines."""
    payloads = read_payloads(spark, path).dropDuplicates(["sha256", "size"])
    end = F.lit("\r\n").cast("binary")
    joined = read_headers(spark, path).join(payloads, ["sha256", "size"])
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select("page_id", "record_type", "payload", F.concat(F.col("header"), end, body, end, end).alias("record"))


def archive_report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archive to the shared folder, reads it back, and tells of every page what its record holds.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``: sizes and digests are those of the payloads as read.
    """
    spark, path = pages.sparkSession, f"{folder(pages.sparkSession)}/archive"
    write_archive(pages, path, least)
    read = read_payloads(spark, path).select(
        "sha256", "size", base32_sha1(F.col("payload")).alias("read_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")).distinct()
    return read_headers(spark, path).join(read, ["sha256", "size"]).select(
        "page_id", "payload_bytes",
        F.when(F.col("payload_digest") == F.col("read_digest"), F.col("read_digest")).otherwise(
            F.raise_error(F.lit("header and payload disagree"))).alias("payload_digest"),
        "record_type", "refers_to")
