"""Counters over log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.functions.levels import level_rank
from sawlog.functions.text import sanitize_label
from sawlog.functions.times import micros
from sawlog.operators.ranking import newest

# Upper bounds of the latency buckets in seconds.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def logs_total(lines: DataFrame) -> DataFrame:
    """Lines by source and level, both made safe as labels."""
    return lines.groupBy(
        sanitize_label(F.col("source"), 128).alias("source"), sanitize_label(F.col("level"), 16).alias("level")
    ).agg(F.count("*").alias("total"))


def latency_histogram(lines: DataFrame, start: str = "ts", end: str = "ingest_ts") -> DataFrame:
    """Cumulative latency buckets per source: ``(source, le, count)``; the last bucket is infinite."""
    us = micros(end) - micros(start)
    timed = lines.where(us.isNotNull())
    buckets = [F.count_if(us <= int(b * 1_000_000)).alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    wide = timed.groupBy("source").agg(*buckets, F.count("*").alias("all"))
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(LATENCY_BUCKETS)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("count")))
    return wide.select("source", F.inline(F.array(*cells)))


def summary_text(count: Column, levels: Column) -> Column:
    """``4 log(s) — 3 ERROR, 1 WARN`` from an array of levels, in falling severity, then by name."""
    def counted(level: Column) -> Column:
        n = F.size(F.filter(levels, lambda x: x.eqNullSafe(level)))
        return F.struct((-F.coalesce(level_rank(level), F.lit(-1))).alias("order"), level.alias("level"),
                        F.concat(n.cast("string"), F.lit(" "), level).alias("text"))

    listed = F.array_join(F.transform(F.array_sort(F.transform(F.array_distinct(levels), counted)), lambda p: p.text), ", ")
    return F.concat(count.cast("string"), F.lit(" log(s) — "), listed)


def level_summary(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch the number of lines and a text such as ``4 log(s) — 3 ERROR, 1 WARN``.

    Levels come in falling severity, then by name.
    """
    counts = batches.groupBy(batch, F.upper("level").alias("level")).agg(F.count("*").alias("n"))
    part = F.struct(
        (-F.coalesce(level_rank(F.col("level")), F.lit(-1))).alias("order"), "level",
        F.concat(F.col("n").cast("string"), F.lit(" "), "level").alias("text"),
    )
    grouped = counts.groupBy(batch).agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(part)).alias("parts"))
    listed = F.array_join(F.transform("parts", lambda p: p.text), ", ")
    return grouped.select(
        batch, "count", F.concat(F.col("count").cast("string"), F.lit(" log(s) — "), listed).alias("text")
    )


def known_sources(lines: DataFrame) -> DataFrame:
    return lines.where(F.coalesce("source", F.lit("")) != "").select("source").distinct().orderBy("source")


def latest_logs(lines: DataFrame, limit: int = 100_000, arrival: str = "line_id") -> DataFrame:
    """The newest lines, in arrival order."""
    return newest(lines, arrival, limit).orderBy(arrival)
