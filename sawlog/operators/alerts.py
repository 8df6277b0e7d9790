"""Alert evaluation on event time: error rates, cooldown, events and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sawlog.functions.times import micros
from sawlog.operators.anchored import anchored_windows
from sawlog.operators.matching import alert_message, match_rules
from sawlog.operators.ranking import rank_in_key
from sawlog.schema import ALERT_EVENT_COLUMNS
from sawlog.session import stored

_RANK_BLOCK = 1 << 18


def error_rate_alerts(lines: DataFrame, rules: DataFrame, time_col: str = "ts") -> DataFrame:
    """Fires of all error-rate rules, before cooldown.

    A rule counts its error lines in the closed window ending at each; when the count reaches
    the threshold it fires and starts again from zero.
    """
    matched = match_rules(lines, rules.where(F.col("type") == "error_rate"))
    return _rate_fires(matched, time_col)


def _rate_fires(matched: DataFrame, time_col: str, order_col: str | None = None) -> DataFrame:
    """Windows over row ranks; ``order_col`` is the time that counts, where it is another than the one to tell.

    A line completes a full window when the line ``threshold - 1`` ranks before it is no more
    than the window older. After a fire, the next one is the first such line at least
    ``threshold`` ranks on, which makes fires the anchors of windows over ranks.
    """
    need = F.greatest(F.col("rule_threshold"), F.lit(1)).cast("bigint")
    errors = matched.select(
        "rule_no", "line_id", micros(order_col or time_col).alias("t"), (need - 1).alias("back"),
        F.coalesce("rule_window_us", F.lit(0)).alias("window_us"),
    ).where("t IS NOT NULL")
    ranked = rank_in_key(errors, "rule_no", "t", "line_id", "rank")
    # Each line goes to its own rank and to the rank that completes a full count with it.
    absent = F.lit(None).cast("bigint")
    own = F.struct(F.col("rank").alias("p"), F.col("t").alias("t"), F.col("line_id").alias("tag"), absent.alias("t_old"))
    later = F.struct((F.col("rank") + F.col("back")).alias("p"), absent.alias("t"), absent.alias("tag"), F.col("t").alias("t_old"))
    pairs = ranked.select("rule_no", "back", "window_us", F.explode(F.array(own, later)).alias("_at"))
    full = (
        pairs.groupBy("rule_no", F.col("_at.p").alias("p"))
        .agg(*[F.max(f"_at.{c}").alias(c) for c in ("t", "tag", "t_old")],
             F.max("back").alias("w"), F.max("window_us").alias("window_us"))
        .where("t - t_old <= window_us")
        .select("rule_no", "p", "w", F.lit(1).cast("bigint").alias("n"), "tag")
    )
    fired = anchored_windows(full, ["rule_no"], min_span=_RANK_BLOCK)
    fired = fired.select("rule_no", F.col("tag").alias("line_id"))
    return matched.join(fired, ["rule_no", "line_id"]).select(
        "rule_no", "rule_name", F.col("rule_severity").alias("severity"),
        alert_message(F.lit("error_rate"), F.lit(""), F.lit(""), need, F.coalesce("rule_window_us", F.lit(0))).alias("message"),
        "source", need.alias("count"), F.col(time_col).alias("fired_at"), "line_id",
        F.coalesce("rule_cooldown_us", F.lit(0)).alias("cooldown_us"), *([order_col] if order_col else []),
    )


def apply_cooldown(events: DataFrame, order: str = "line_id", at: str = "fired_at") -> DataFrame:
    """Events left after each rule's cooldown; needs ``rule_name, cooldown_us``, a time ``at`` and an order id.

    Only an event that passes restarts the clock of its rule; a cooldown of zero or less lets all
    pass. A rule fires at most once per order id. Events of a rule at one instant are combined
    before the shuffle, as only the first of them can pass.
    An event without a time passes where no cooldown applies; where one does it is left out, as no clock can tell when it was.
    """
    waits = F.coalesce("cooldown_us", F.lit(0)) > 0
    points = (
        events.where(waits).groupBy("rule_name", micros(at).alias("p"))
        .agg(F.min(order).alias("tag"), F.max("cooldown_us").alias("_cooldown"))
        .select("rule_name", "p", (F.col("_cooldown") - 1).alias("w"), F.lit(1).cast("bigint").alias("n"), "tag")
    )
    allowed = anchored_windows(points, ["rule_name"]).select("rule_name", F.col("tag").alias(order))
    kept = events.where(waits).join(allowed, ["rule_name", order]).select(*events.columns)
    return events.where(~waits).unionByName(kept)


def _line_events(matched: DataFrame, time_col: str) -> DataFrame:
    return matched.where(F.col("rule_type") != "error_rate").select(
        "rule_no", "rule_name", F.col("rule_severity").alias("severity"),
        alert_message(F.col("rule_type"), F.col("level"), F.col("message"), F.lit(0), F.lit(0)).alias("message"),
        "source", F.lit(0).cast("bigint").alias("count"), F.col(time_col).alias("fired_at"), "line_id",
        F.coalesce("rule_cooldown_us", F.lit(0)).alias("cooldown_us"),
    )


_MATCH_COLUMNS = [
    "rule_no", "rule_name", "rule_type", "rule_severity", "rule_threshold", "rule_window_us", "rule_cooldown_us",
    "line_id", "source", "level", "message",
]


def alert_candidates(lines: DataFrame, rules: DataFrame, time_col: str = "ts") -> DataFrame:
    """All fires of pattern, level and error-rate rules, before cooldown."""
    return _candidates(match_rules(lines, rules), time_col)


def _candidates(matched: DataFrame, time_col: str) -> DataFrame:
    return _line_events(matched, time_col).unionByName(
        _rate_fires(matched.where(F.col("rule_type") == "error_rate"), time_col)
    )


def evaluate_alerts(lines: DataFrame, rules: DataFrame, time_col: str = "ts") -> DataFrame:
    """Alert events of ``lines(line_id, source, level, message, ts)`` under a rule table.

    The lines are read and matched once; what matches is stored in a narrow table, from which
    rates and cooldowns are worked out.
    """
    matched = stored(match_rules(lines, rules).select(*_MATCH_COLUMNS, time_col))
    return stored_events(apply_cooldown(_candidates(matched, time_col)))


def event_id(rule: str = "rule_name", at: str = "fired_at", order: str = "line_id"):
    """Id that a repeated run gives again to the same event."""
    return F.sha2(F.concat_ws("|", rule, micros(at).cast("string"), F.col(order).cast("string")), 256)


def stored_events(events: DataFrame, order: str = "line_id") -> DataFrame:
    """Fired events as rows of the ``alert_events`` table."""
    return events.select(
        event_id(order=order).alias("id"), "rule_name", "severity", "message", "source", "count", "fired_at",
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
    ).select(*ALERT_EVENT_COLUMNS)


def alerts_total(events: DataFrame) -> DataFrame:
    return events.groupBy("rule_name", "severity").agg(F.count("*").alias("total"))


def rule_stats(events: DataFrame) -> DataFrame:
    """Fire count and last fire of each rule that fired."""
    return events.groupBy("rule_name").agg(
        F.count("*").alias("fire_count"), F.max("fired_at").alias("last_fired")
    )


def rule_status(rules: DataFrame, events: DataFrame) -> DataFrame:
    """Every rule with its fire count and last fire, zero and null when it never fired."""
    stats = rule_stats(events).withColumnRenamed("rule_name", "name")
    return rules.join(stats, "name", "left").withColumn("fire_count", F.coalesce("fire_count", F.lit(0)))


def recent_events(events: DataFrame, limit: int = 100, keep: int | None = None) -> DataFrame:
    """The newest ``limit`` events (100 if not positive) in firing order; ``keep`` bounds them where given."""
    shown = limit if limit > 0 else keep or 100
    shown = shown if keep is None else min(shown, keep)
    last = events.orderBy(F.desc("fired_at"), F.desc("id")).limit(shown)
    return last.orderBy("fired_at", "id")
