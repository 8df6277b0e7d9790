"""The flagship query: what needs attention, by source and level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sawlog.operators.alerts import evaluate_alerts
from sawlog.operators.collapse import collapse_repeats
from sawlog.operators.filters import filter_logs
from sawlog.operators.parse import parse_logs
from sawlog.session import stored


def triage(
    raw: DataFrame, rules: DataFrame, min_level: str = "warn", pattern: str | None = None, window: str | int = "1h"
) -> DataFrame:
    """Per source and level of the lines that pass the filters: lines, collapsed rows, alerts fired.

    Alerts see every line, before the filters. The lines are parsed once and stored, as the
    operators below read them several times.
    """
    lines = stored(parse_logs(raw).select("line_id", "source", "ts", "level", "message"))
    collapsed = collapse_repeats(filter_logs(lines, min_level, pattern), window)
    shown = collapsed.groupBy("source", "level").agg(F.sum("count").alias("lines"), F.count("*").alias("entries"))
    fired = evaluate_alerts(lines, rules).groupBy("source").agg(
        F.count("*").alias("alerts"), F.max("fired_at").alias("last_alert")
    )
    return shown.join(fired, "source", "left").select(
        "source", "level", "lines", "entries", F.coalesce("alerts", F.lit(0)).alias("alerts"), "last_alert"
    )
