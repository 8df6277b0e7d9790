"""Source health from a log of health events.

``health_events(source, ts, seq, kind, status, error)``: ``kind`` is ``register`` or ``status``;
``seq`` orders events at one time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sawlog.functions.times import micros

STATUSES = ["healthy", "degraded", "failed", "stopped"]
STARTING = "starting"
# The sign shown for each status.
SYMBOLS = {"healthy": "✓", "degraded": "⚠", "failed": "✗", "stopped": "⏸"}
_HOUR_US, _SECOND_US = 3_600_000_000, 1_000_000


def _status() -> Column:
    return F.when(F.col("kind") == "register", F.lit(STARTING)).otherwise(F.col("status"))


def _lag(partition: list[str], order: list[str], value: str) -> Column:
    return F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))


def _with_previous(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the value of the row before, per source in the order of (ts, seq).

    A source's events are ordered inside each second only. The first of a second takes the last value of the second before,
    and the first second of an hour that of the hour before, so a busy source is spread over many tasks
    and no task orders more than a second's events, an hour's seconds or a source's hours.
    """
    timed = df.withColumns({"_hour": F.floor(micros("ts") / _HOUR_US), "_second": F.floor(micros("ts") / _SECOND_US)})
    seconds = timed.groupBy("source", "_hour", "_second").agg(F.max_by(value, F.struct("ts", "seq")).alias("_last"))
    hours = seconds.groupBy("source", "_hour").agg(F.max_by("_last", "_second").alias("_last"), F.min("_second").alias("_second"))
    hours = hours.select("source", "_second", _lag(["source"], ["_hour"], "_last").alias("_hour_before"))
    seconds = seconds.withColumn("_second_before", _lag(["source", "_hour"], ["_second"], "_last"))
    # Only the first second of an hour finds a partner; statuses are never null, so the others keep their own.
    carried = seconds.join(hours, ["source", "_second"], "left").select(
        "source", "_second", F.coalesce("_second_before", "_hour_before").alias("_carried"))
    inside = Window.partitionBy("source", "_second").orderBy("ts", "seq")
    placed = timed.withColumns({"_before": F.lag(value).over(inside), "_place": F.row_number().over(inside)})
    joined = placed.join(carried, ["source", "_second"], "left")
    before = F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return joined.withColumn(out, before).drop("_hour", "_second", "_before", "_place", "_carried")


def health_transitions(events: DataFrame) -> DataFrame:
    """Status changes ``(source, ts, seq, old_status, new_status, message)``.

    Registering sets ``starting`` without a change event; a source never registered starts empty.
    """
    tracked = _with_previous(events.withColumn("_status", _status()), "_status", "old_status")
    old = F.coalesce("old_status", F.lit(""))
    return tracked.where((F.col("kind") == "status") & (old != F.col("status"))).select(
        "source", "ts", "seq", old.alias("old_status"), F.col("status").alias("new_status"),
        F.concat(F.lit('Source "'), "source", F.lit('" health changed: '), old, F.lit(" -> "), "status").alias("message"),
    )


def health_current(events: DataFrame) -> DataFrame:
    """Latest state of each source; registering again starts it anew.

    ``(source, status, last_error, last_update, error_count, start_time)``. Two aggregations, both combined
    before the shuffle: the last registration of each source, then the events from it on.
    """
    at = F.struct("ts", "seq")
    epochs = events.groupBy("source").agg(F.max(F.when(F.col("kind") == "register", at)).alias("_epoch"))
    alive = events.join(epochs, "source").where(F.col("_epoch").isNull() | (at >= F.col("_epoch")))
    error = F.when(F.col("kind") == "status", F.col("error"))
    return alive.groupBy("source").agg(
        F.max_by(_status(), at).alias("status"),
        F.max(F.when(error.isNotNull(), F.struct("ts", "seq", error.alias("error")))).getField("error").alias("last_error"),
        F.max("ts").alias("last_update"), F.count(error).alias("error_count"), F.min("ts").alias("start_time"),
    )


def health_counts(health: DataFrame) -> DataFrame:
    """One row of counts by status, two totals and the overall status.

    ``total_all`` counts every source, ``total_reported`` leaves out those still starting.
    """
    counted = health.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total_all")
    )
    overall = F.when(F.col("failed") > 0, "unhealthy").when(F.col("degraded") > 0, "degraded").otherwise("healthy")
    reported = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    return counted.withColumns({"total_reported": reported, "overall": overall})


def all_healthy(health: DataFrame) -> DataFrame:
    return health.agg(F.coalesce(F.bool_and(F.col("status") == "healthy"), F.lit(True)).alias("all_healthy"))


def health_summary_line(health: DataFrame) -> DataFrame:
    """The counts as one line of text."""
    c = health_counts(health)
    parts = [F.lit("Sources: "), F.col("total_all"), F.lit(" total")]
    for status in STATUSES:
        parts += [F.lit(f" | {SYMBOLS[status]} "), F.col(status), F.lit(f" {status}")]
    return c.select(F.concat(*[p.cast("string") for p in parts]).alias("summary"))


def source_gauges(health: DataFrame) -> DataFrame:
    """One row per source and status with 1 for the current status, else 0."""
    states = F.array_union(F.array(*map(F.lit, STATUSES)), F.array("status"))
    return health.select("source", "status", F.explode(states).alias("gauge")).select(
        "source", F.col("gauge").alias("status"), (F.col("gauge") == F.col("status")).cast("int").alias("value")
    )


def active_sources(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("status").isin("healthy", "degraded", "failed")).alias("active"))


def source_errors_total(events: DataFrame) -> DataFrame:
    """Errors reported by each source, over all its life."""
    return events.where(F.col("kind") == "status").groupBy("source").agg(F.count("error").alias("errors"))
