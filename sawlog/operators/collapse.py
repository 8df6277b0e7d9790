"""Collapsing repeated messages in anchored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.functions.times import duration_us, format_duration, micros
from sawlog.operators.anchored import anchored_windows

DEFAULT_WINDOW_US = 5_000_000
DEFAULT_MIN_COUNT = 2


def window_settings(window: str | int, min_count: int) -> tuple[int, int]:
    """Window in microseconds and least count, with the defaults for values out of range."""
    us = duration_us(window)
    return (us if us > 0 else DEFAULT_WINDOW_US), (min_count if min_count >= 2 else DEFAULT_MIN_COUNT)


def repeat_suffix(message: Column, count: Column, span_us: Column, min_count: int) -> Column:
    suffix = F.concat(F.lit(" (x"), count.cast("string"), F.lit(" in last "), format_duration(span_us), F.lit(")"))
    return F.concat(message, F.when(count >= min_count, suffix).otherwise(F.lit("")))


def repeat_key() -> Column:
    """Digest of (source, level, message), each with its length so that parts cannot run together."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "level", "message")]
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def collapse_repeats(
    df: DataFrame,
    window: str | int = DEFAULT_WINDOW_US,
    min_count: int = DEFAULT_MIN_COUNT,
    time_col: str = "ts",
) -> DataFrame:
    """One row per window of equal (source, level, message): its first line, counted.

    The first line opens a window; lines up to ``window`` later only count; a later one opens
    the next. From ``min_count`` on the message tells the count and the time between first and
    last. Needs a unique ``line_id``; lines without a time are left out.

    The windows are found on digests, times and ids alone, with lines at one instant combined
    before the shuffle; a join by ``line_id``, which cannot be skewed, then fetches the first lines.
    Parsed lines are read twice, so a costly parse should be written to a table before.
    """
    window_us, least = window_settings(window, min_count)
    points = (
        df.where(F.col(time_col).isNotNull())
        .select(repeat_key().alias("_key"), micros(time_col).alias("p"), "line_id")
        .groupBy("_key", "p")
        .agg(F.count("*").alias("n"), F.min("line_id").alias("tag"))
        .withColumn("w", F.lit(window_us).cast("bigint"))
    )
    windows = anchored_windows(points, ["_key"]).select(
        F.col("tag").alias("line_id"), F.col("n").alias("count"), F.col("p").alias("_first"), F.col("last").alias("_last")
    )
    kept = [c for c in df.columns if c not in ("count", "first_seen", "last_seen")]
    suffixed = repeat_suffix(F.col("message"), F.col("count"), F.col("_last") - F.col("_first"), least)
    return df.select(*kept).join(windows, "line_id").select(
        *[suffixed.alias(c) if c == "message" else F.col(c) for c in kept],
        "count",
        F.timestamp_micros("_first").alias("first_seen"),
        F.timestamp_micros("_last").alias("last_seen"),
    )
