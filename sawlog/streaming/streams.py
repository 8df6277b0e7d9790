"""Streaming forms of the operators, on event time with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.functions.times import micros
from sawlog.operators.alerts import _line_events, event_id
from sawlog.operators.collapse import repeat_suffix, window_settings
from sawlog.operators.filters import filter_logs
from sawlog.operators.matching import alert_message, match_rules
from sawlog.operators.metrics import logs_total
from sawlog.operators.parse import parse_logs
from sawlog.schema import ALERT_EVENT_COLUMNS
from sawlog.session import ROCKSDB
from sawlog.sinks.files import write_all
from sawlog.streaming.flush import watermarked
from sawlog.streaming.processors import AlertProcessor, CollapseProcessor, HealthProcessor

DEFAULT_DELAY = "10 seconds"
GAUGE_INTERVAL = "15 seconds"
FLUSH_INTERVAL = "5 seconds"
HEALTH_SHARDS = 256  # of the sources; a checkpoint keeps to it


def _check_state_store(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != ROCKSDB:
        raise ValueError(f"set {key} to {ROCKSDB}")


def stream_parse(raw: DataFrame, fmt="auto", min_level: str | None = None, pattern: str | None = None) -> DataFrame:
    """Parse and filter a stream of raw lines; keeps no state."""
    return filter_logs(parse_logs(raw, fmt), min_level, pattern)


def _run(df: DataFrame, keys: list[str], processor, schema: str) -> DataFrame:
    _check_state_store(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def _timed(lines: DataFrame, time_col: str, delay: str) -> DataFrame:
    return watermarked(lines.where(F.col(time_col).isNotNull()), time_col, delay).withColumn("t", micros(time_col))


def stream_collapse(
    lines: DataFrame, window: str | int = 0, min_count: int = 2, time_col: str = "ts", delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Collapsed rows, each once its window is closed for good by the watermark; ``run_to_end`` closes the last ones."""
    window_us, least = window_settings(window, min_count)
    keys = ["source", "level", "message"]
    # As in the batch form, a missing text and an empty one are the same.
    rows = _timed(lines, time_col, delay).select(*[F.coalesce(c, F.lit("")).alias(c) for c in keys], "t", "line_id", time_col)
    schema = "source string, level string, message string, line_id bigint, count bigint, first_us bigint, last_us bigint"
    closed = _run(rows, keys, CollapseProcessor(window_us), schema)
    return closed.select(
        "line_id", "source", "level",
        repeat_suffix(F.col("message"), F.col("count"), F.col("last_us") - F.col("first_us"), least).alias("message"),
        "count", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"),
    )


def stream_alerts(
    lines: DataFrame, rules: DataFrame, time_col: str = "ts", delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Alert events of a stream: error rates and cooldowns, in one stateful step per rule.

    Pattern and level rules without cooldown need no order and no state.
    """
    matched = match_rules(watermarked(lines, time_col, delay), rules)
    rate = F.col("rule_type") == "error_rate"
    free = ~rate & (F.coalesce("rule_cooldown_us", F.lit(0)) <= 0)
    need = F.greatest(F.coalesce("rule_threshold", F.lit(1)), F.lit(1)).cast("bigint")
    window_us = F.coalesce("rule_window_us", F.lit(0))
    rows = matched.where(~free & F.col(time_col).isNotNull()).select(
        "rule_name", micros(time_col).alias("t"), "line_id", "source",
        alert_message(F.col("rule_type"), F.col("level"), F.col("message"), need, window_us).alias("message"),
        F.col("rule_severity").alias("severity"), rate.alias("rate"), need.alias("need"),
        window_us.alias("window_us"), F.coalesce("rule_cooldown_us", F.lit(0)).alias("cooldown_us"), time_col,
    )
    schema = (
        "rule_name string, severity string, message string, source string, count bigint, fired_us bigint,"
        " line_id bigint"
    )
    fired = _run(rows, ["rule_name"], AlertProcessor(), schema).withColumn("fired_at", F.timestamp_micros("fired_us"))
    at_once = _line_events(matched.where(free), time_col)
    columns = ["rule_name", "severity", "message", "source", "count", "fired_at", "line_id"]
    both = fired.select(*columns).unionByName(at_once.select(*columns))
    return both.select(
        event_id().alias("id"), *[c for c in columns if c != "line_id"],
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
    ).select(*ALERT_EVENT_COLUMNS)


def stream_error_rate(lines: DataFrame, rules: DataFrame, time_col: str = "ts", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Fires of the error-rate rules alone, before cooldown."""
    rates = rules.where(F.col("type") == "error_rate").withColumn("cooldown_us", F.lit(0).cast("bigint"))
    return stream_alerts(lines, rates, time_col, delay)


def stream_cooldown(lines: DataFrame, rules: DataFrame, time_col: str = "ts", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Events of the pattern and level rules after their cooldown."""
    return stream_alerts(lines, rules.where(F.col("type").isin("pattern", "level")), time_col, delay)


def _health_rows(events: DataFrame, delay: str) -> DataFrame:
    """Events under the number of their source's shard: a call of the processor costs some milliseconds, too dear for each source."""
    shard = F.pmod(F.xxhash64("source"), F.lit(HEALTH_SHARDS)).alias("shard")
    return _timed(events, "ts", delay).select(shard, "source", "t", "seq", "kind", "status", "error", "ts")


def stream_health_transitions(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    schema = "source string, at_us bigint, seq bigint, old_status string, new_status string"
    out = _run(_health_rows(events, delay), ["shard"], HealthProcessor(changes=True), schema)
    return out.select(
        "source", F.timestamp_micros("at_us").alias("ts"), "seq", "old_status", "new_status",
        F.concat(
            F.lit('Source "'), "source", F.lit('" health changed: '), "old_status", F.lit(" -> "), "new_status"
        ).alias("message"),
    )


def stream_health(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """State of a source after each of its events; the last row of a source is its current state."""
    schema = (
        "source string, at_us bigint, seq bigint, status string, last_error string, error_count bigint, start_us bigint"
    )
    out = _run(_health_rows(events, delay), ["shard"], HealthProcessor(changes=False), schema)
    return out.select(
        "source", "status", "last_error", F.timestamp_micros("at_us").alias("last_update"), "seq", "error_count",
        F.timestamp_micros("start_us").alias("start_time"),
    )


def stream_metrics(lines: DataFrame) -> DataFrame:
    """Running line counts by source and level, for update or complete mode."""
    return logs_total(lines)


def stream_metrics_by_interval(
    lines: DataFrame, interval: str = GAUGE_INTERVAL, time_col: str = "ts", delay: str = DEFAULT_DELAY
) -> DataFrame:
    """Line counts by source and level in tumbling windows."""
    windowed = watermarked(lines, time_col, delay).groupBy(F.window(time_col, interval), "source", "level")
    return windowed.agg(F.count("*").alias("total")).select(
        F.col("window.start").alias("start"), "source", "level", "total"
    )


def stream_sinks(df: DataFrame, sinks: list[Callable[[DataFrame], None]], checkpoint: str, interval: str = FLUSH_INTERVAL):
    """Start a query that writes every micro-batch to all sinks; the trigger is the flush interval."""
    writer = df.writeStream.foreachBatch(lambda batch, _: write_all(batch, sinks))
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
