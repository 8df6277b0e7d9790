"""Raw lines from files and from any string column; file inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sawlog.functions.text import derive_source_name
from sawlog.schema import MAX_LINE_BYTES

MAX_LOG_FILE_BYTES = 1 << 30
DEFAULT_ROOTS = ["/var/log"]


def clean_line(df: DataFrame, column: str = "raw", max_line_bytes: int | None = MAX_LINE_BYTES) -> DataFrame:
    """Drop one trailing carriage return, leave out empty lines, and cut lines over ``max_line_bytes``, unless that is None.

    Cut lines are marked in ``truncated``.
    """
    text = F.regexp_replace(F.col(column), r"\r\z", "")
    step = df.withColumn(column, text).where(F.col(column) != "")
    if max_line_bytes is None:
        return step.withColumn("truncated", F.lit(False))
    long = F.octet_length(column) > max_line_bytes
    cut = F.make_valid_utf8(F.substring(F.encode(F.col(column), "UTF-8"), 1, max_line_bytes).cast("string"))
    return step.withColumns({
        "truncated": long,
        column: F.when(long, cut).otherwise(F.col(column)),
    })


def read_log_files(
    spark: SparkSession, paths: str | list[str], source: str | Column | None = None, max_line_bytes: int | None = MAX_LINE_BYTES
) -> DataFrame:
    """Lines of text files: ``source, file, raw, truncated, ingest_ts``; ``max_line_bytes`` as in ``clean_line``.

    Lines end at ``\\n`` alone. The source is the file's path unless given. ``ingest_ts`` is the
    file's modification time, which a repeated read gives again.
    """
    text = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else paths)
    file = F.regexp_replace(F.url_decode("_metadata.file_path"), "^file:/*", "/")
    named = file if source is None else (F.lit(source) if isinstance(source, str) else source)
    lines = text.select(
        named.alias("source"), file.alias("file"), F.col("value").alias("raw"),
        F.col("_metadata.file_modification_time").alias("ingest_ts"),
    )
    return clean_line(lines, max_line_bytes=max_line_bytes)


def lines_from(df: DataFrame, column: str | Column, source: str | Column = "stdin") -> DataFrame:
    """Any string column as raw lines: the other columns stay, ``source`` and ``raw`` are set.

    A string ``source`` is a literal name.
    """
    text = F.col(column) if isinstance(column, str) else column
    named = F.lit(source) if isinstance(source, str) else source
    return df.withColumns({"raw": text, "source": named}).where(F.col("raw") != "")


def merge_sources(*frames: DataFrame) -> DataFrame:
    """All lines of several sources, batch or streaming; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def log_inventory(spark: SparkSession, roots: list[str] | None = None, max_bytes: int | None = MAX_LOG_FILE_BYTES) -> DataFrame:
    """``(name, type, path, length, too_large)`` of all ``*.log`` files below the roots but empty ones.

    ``too_large`` marks files over ``max_bytes``, for callers that don't offer them; none where that is None.

    Only file status is read, on the executors' side of Spark's file listing, not the content.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log")
        .load(roots or DEFAULT_ROOTS)
        .select("path", "length")
        .where(F.col("length") > 0)
    )
    path = F.regexp_replace("path", "^file:/*", "/")
    return found.select(
        derive_source_name(path).alias("name"), F.lit("file").alias("type"), path.alias("path"), "length",
        F.lit(False).alias("too_large") if max_bytes is None else (F.col("length") > max_bytes).alias("too_large"),
    ).dropDuplicates(["path"])
