"""Keyed tables: difference, upsert, first of a name, what changed since."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def diff_snapshots(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``(key, change)`` with ``added``, ``removed``, ``changed`` or ``same`` for every key."""
    before = old.select(F.col(key).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in cols])
    after = new.select(F.col(key).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    same = reduce(lambda a, b: a & b, [F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")) for c in cols], F.lit(True))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(same, "same").otherwise("changed")
    )
    joined = before.join(after, F.col("_old") == F.col("_new"), "full_outer")
    return joined.select(F.coalesce("_old", "_new").alias(key), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose key is not among them."""
    return old.join(new, key, "left_anti").unionByName(new)


def dedupe_first(df: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """The first row of each key in the given order, combined before the shuffle."""
    by = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return first.select(key, "_row.*").select(*df.columns)


def table_version(df: DataFrame, column: str = "updated_at") -> DataFrame:
    """Newest update time, the epoch for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.timestamp_micros(F.lit(0))).alias("version"))


def changed_since(df: DataFrame, watermark, column: str = "updated_at") -> DataFrame:
    """Rows updated after the watermark; none when there is no watermark yet."""
    if watermark is None:
        return df.where(F.lit(False))
    return df.where(F.col(column) > F.lit(watermark))


def by_name(df: DataFrame, name: str = "name") -> DataFrame:
    return df.orderBy(name)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of a sorted frame."""
    return df.offset(max(offset, 0)).limit(limit)


def last_written(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each key written last; of equal times the greatest row."""
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *rest)).alias("_row"))
    return last.select(key, "_row.*").select(*df.columns)
