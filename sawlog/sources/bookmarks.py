"""Bookmarks: how far each file has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sawlog.operators.tables import last_written


def bookmarks(reads: DataFrame) -> DataFrame:
    """The latest ``(file, offset, inode, saved_at)`` of each file from a log of reads."""
    at = F.struct("saved_at", "offset", "inode")
    return reads.groupBy("file").agg(F.max(at).alias("_at")).select(
        "file", "_at.offset", "_at.inode", "_at.saved_at"
    )


def upsert_bookmarks(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Both sets with the one saved last under each name."""
    return last_written(old.unionByName(new), key, "saved_at")


def load_bookmark(marks: DataFrame, name: str) -> dict:
    """Starting offsets ``{file: [offset, inode]}`` of one named bookmark; empty if there is none."""
    rows = marks.where(F.col("name") == name).select("file", "offset", "inode").limit(1).collect()
    return {r.file: [r.offset, r.inode] for r in rows}


def delete_bookmark(marks: DataFrame, name: str) -> DataFrame:
    return marks.where(F.col("name") != name)


def list_bookmarks(marks: DataFrame) -> DataFrame:
    return marks.orderBy("name")
