"""Micro-batch alerting with rules that may change while it runs, and a side output for late rows.

State is a small table per micro-batch under ``state_path``, so a batch that is run again
starts from the same state and writes the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.functions.times import duration_us, micros
from sawlog.operators.alerts import _line_events, _rate_fires, apply_cooldown, stored_events
from sawlog.operators.matching import bind_rules, match_rules
from sawlog.schema import RULE_SCHEMA

_CLOCK_SCHEMA = "rule_name string, fired_us bigint"
_ERROR_SCHEMA = "rule_name string, line_id bigint, source string, t bigint"
_CLOCK_ID = -(2**63)  # stands before every line at one instant


def _forget(spark: SparkSession, path: str) -> None:
    """Remove a state folder that no batch can need again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class ReloadingAlerts:
    """``foreachBatch`` function: reads the rules anew for every micro-batch.

    Rules are known by name, so the cooldown clock and the errors counted so far survive a
    change. Rows are taken in the order of event time within a micro-batch and after all rows
    before it, as by arrival: a late row counts as of the last fire of its rule, and a late error as of the last
    error still counted, though its alert tells its own time. A broken new rule set keeps the last good one in force. The states of the last two batches are kept.
    """

    def __init__(
        self, load_rules: Callable[[SparkSession], DataFrame], emit: Callable[[DataFrame], None], state_path: str,
        time_col: str = "ts",
    ):
        self.load_rules, self.emit, self.state_path, self.time_col = load_rules, emit, state_path, time_col
        self.good: list | None = None

    def _state(self, spark: SparkSession, kind: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.state_path}/{kind}/batch={batch_id}")

    def _matched(self, lines: DataFrame) -> DataFrame:
        """The lines under the rules, which are read once; the good ones are kept."""
        try:
            rules = bind_rules(self.load_rules(lines.sparkSession))
            matched = match_rules(lines, rules)
        except ValueError:
            if self.good is None:
                raise
            rules = self.good
            matched = match_rules(lines, rules)
        self.good = rules
        return matched

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        clocks = self._state(spark, "clock", batch_id - 1, _CLOCK_SCHEMA)
        before = self._state(spark, "errors", batch_id - 1, _ERROR_SCHEMA)
        matched = self._matched(lines)
        rules = spark.createDataFrame(self.good, RULE_SCHEMA)
        # Matched once per batch. State tables have a row per rule, or the errors of one window and rule.
        own = [c for c in matched.columns if c.startswith("rule_") and c != "rule_no"]
        newest = before.groupBy("rule_name").agg(F.max("t").alias("newest"))
        matched = matched.join(F.broadcast(newest), "rule_name", "left").select(
            F.xxhash64("rule_name").alias("rule_no"), *own, "line_id", "source", "level", "message", F.col(self.time_col).alias("ts"),
            F.timestamp_micros(F.greatest(micros(self.time_col), "newest")).alias("at")).persist()
        rate = F.col("rule_type") == "error_rate"
        # Errors still counted from batches before come in with the rule as it is now.
        numbered = rules.where(F.col("type") == "error_rate").select(*[F.col(f.name).alias(f"rule_{f.name}") for f in rules.schema])
        held = before.join(F.broadcast(numbered), "rule_name").select(
            F.xxhash64("rule_name").alias("rule_no"), *own, "line_id", "source", F.lit("error").alias("level"), F.lit("").alias("message"),
            F.timestamp_micros("t").alias("ts"), F.timestamp_micros("t").alias("at"))
        counted = held.unionByName(matched.where(rate))
        fires = _rate_fires(counted, "ts", "at").persist()
        at_once = _line_events(matched.where(~rate), "ts")
        # The last fire that passed stands before the new ones and is taken out again.
        past = clocks.join(rules.select(F.col("name").alias("rule_name"), "cooldown_us"), "rule_name")
        clock_rows = past.select(
            F.lit(0).cast("bigint").alias("rule_no"), "rule_name", *[F.lit("").alias(c) for c in ("severity", "message", "source")],
            F.lit(0).cast("bigint").alias("count"), F.timestamp_micros("fired_us").alias("fired_at"),
            F.lit(_CLOCK_ID).cast("bigint").alias("line_id"), "cooldown_us",
        )
        events = at_once.unionByName(fires.drop("at")).unionByName(clock_rows).join(F.broadcast(clocks), "rule_name", "left")
        events = events.withColumn("at", F.timestamp_micros(F.greatest(micros("fired_at"), "fired_us"))).drop("fired_us")
        passed = apply_cooldown(events, at="at").where(F.col("line_id") != _CLOCK_ID).persist()
        try:
            self._save_clocks(clocks, passed, batch_id)
            self._save_errors(counted, fires, batch_id)
            self.emit(stored_events(passed.drop("at")))
        finally:
            for frame in (passed, fires, matched):
                frame.unpersist()
        for kind in ("clock", "errors"):
            _forget(spark, f"{self.state_path}/{kind}/batch={batch_id - 2}")

    def _save_clocks(self, clocks: DataFrame, passed: DataFrame, batch_id: int) -> None:
        last = passed.where("cooldown_us > 0").select("rule_name", micros("at").alias("fired_us"))
        merged = clocks.unionByName(last).groupBy("rule_name").agg(F.max("fired_us").alias("fired_us"))
        merged.write.mode("overwrite").parquet(f"{self.state_path}/clock/batch={batch_id}")

    def _save_errors(self, counted: DataFrame, fires: DataFrame, batch_id: int) -> None:
        """Errors after the last fire of their rule that are still inside its window."""
        at = F.struct(micros("at").alias("t"), F.col("line_id"))
        last = fires.groupBy("rule_name").agg(F.max(at).alias("_fire"))
        newest = counted.groupBy("rule_name").agg(F.max(micros("at")).alias("_newest"))
        rest = counted.join(newest, "rule_name").join(last, "rule_name", "left").where(
            (F.col("_fire").isNull() | (at > F.col("_fire")))
            & (micros("at") >= F.col("_newest") - F.coalesce("rule_window_us", F.lit(0)))
        )
        rest.select("rule_name", "line_id", "source", micros("at").alias("t")).write.mode("overwrite").parquet(
            f"{self.state_path}/errors/batch={batch_id}"
        )


class LateRows:
    """``foreachBatch`` function that parts rows later than the watermark from the rest.

    The watermark of a micro-batch is the latest time before it, less the delay.
    """

    def __init__(
        self, on_time: Callable[[DataFrame], None], late: Callable[[DataFrame], None], state_path: str,
        delay: str = "10s", time_col: str = "ts",
    ):
        self.on_time, self.late, self.state_path = on_time, late, state_path
        self.delay_us, self.time_col = duration_us(delay), time_col

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        newest = None
        if batch_id > 0:
            newest = spark.read.parquet(f"{self.state_path}/newest/batch={batch_id - 1}").first()[0]
        at = micros(self.time_col)
        is_late = F.lit(False) if newest is None else F.coalesce(at <= newest - self.delay_us, F.lit(False))
        rows.persist()
        try:
            seen = rows.agg(F.max(F.greatest(at, F.lit(newest).cast("bigint"))).alias("newest"))
            seen = seen.select(F.coalesce("newest", F.lit(newest).cast("bigint")).alias("newest"))
            seen.write.mode("overwrite").parquet(f"{self.state_path}/newest/batch={batch_id}")
            self.late(rows.where(is_late))
            self.on_time(rows.where(~is_late))
        finally:
            rows.unpersist()
        _forget(spark, f"{self.state_path}/newest/batch={batch_id - 2}")
