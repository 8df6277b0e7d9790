"""Alert rules from a table of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sawlog.functions.times import parse_duration
from sawlog.schema import RULE_SCHEMA, column_or_null

DEFAULT_COOLDOWN_US = 300_000_000


def load_rules(df: DataFrame, default_cooldown_us: int = DEFAULT_COOLDOWN_US, strict: bool = False) -> DataFrame:
    """Enabled rules with ``window`` and ``cooldown`` texts as microseconds and severity in lower case.

    A missing cooldown is the default. A malformed duration counts as missing, or raises when
    ``strict``.
    """
    enabled = F.coalesce(column_or_null(df, "enabled", "boolean"), F.lit(True))
    kept = df.where(enabled)

    def duration(name: str, default: int):
        text = F.coalesce(column_or_null(df, name, "string"), F.lit(""))
        us = parse_duration(text)
        if strict:
            broken = F.raise_error(F.concat(F.lit("rule "), F.col("name"), F.lit(f": invalid {name} "), text))
            us = F.when((text != "") & us.isNull(), broken.cast("bigint")).otherwise(us)
        return F.coalesce(F.when(text != "", us), F.lit(default)).cast("bigint").alias(f"{name}_us")

    return kept.select(
        "name", "type", F.lower("severity").alias("severity"),
        *[column_or_null(df, c, "string").cast("string").alias(c) for c in ("pattern", "level", "source")],
        column_or_null(df, "threshold", "bigint").cast("bigint").alias("threshold"),
        duration("window", 0), duration("cooldown", default_cooldown_us),
    ).select(*RULE_SCHEMA.fieldNames())
