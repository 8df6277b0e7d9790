"""Alert history: listing, acknowledging, purging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.functions.times import duration_us
from sawlog.operators.tables import page
from sawlog.session import stored
from sawlog.sinks.files import cutoff_day, drop_old_days, finish_swaps, replace_days

DEFAULT_LIMIT = 100
RETENTION = "720h"
UNDATED = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder name of rows without a day


def list_alert_events(
    events: DataFrame,
    severity: str | None = None,
    rule: str | None = None,
    source: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int = 0,
    offset: int = 0,
    max_limit: int | None = None,
) -> DataFrame:
    """Events under all given conditions, newest first; times are inclusive.

    No limit means 100. A service that wants to bound what one call lists gives ``max_limit``. Equal times are ordered by id.
    On a table partitioned by ``fired_on`` (see ``append_alert_events``) the time range prunes it.
    """
    for column, value in (("severity", severity), ("rule_name", rule), ("source", source)):
        if value:
            events = events.where(F.col(column) == value)
    dated = "fired_on" in events.columns
    for value, column_test in ((start, "__ge__"), (end, "__le__")):
        if value is not None:
            events = events.where(getattr(F.col("fired_at"), column_test)(F.lit(value)))
            if dated:
                events = events.where(getattr(F.col("fired_on"), column_test)(F.lit(value).cast("date")))
    size = DEFAULT_LIMIT if limit <= 0 else min(limit, max_limit or limit)
    return page(events.orderBy(F.desc("fired_at"), F.desc("id")), size, offset)


def acknowledge(events: DataFrame, ids: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The events with the asked ids acknowledged, and each asked ``id`` with whether it was ``found``.

    An event acknowledged before keeps its time and counts as not found.
    """
    asked = ids.select("id").distinct()
    marked = events.join(asked.withColumn("_asked", F.lit(True)), "id", "left")
    when = F.coalesce("acknowledged_at", F.when(F.col("_asked"), F.lit(now).cast("timestamp")))
    updated = marked.withColumn("acknowledged_at", when).select(*events.columns)
    open_ids = events.where("acknowledged_at IS NULL").select("id", F.lit(True).alias("found"))
    result = asked.join(open_ids, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
    return updated, result


def purge_older(events: DataFrame, now: datetime, keep: str | int = RETENTION) -> tuple[DataFrame, DataFrame]:
    """The events within the retention time, and the number ``deleted``."""
    cutoff = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - duration_us(keep))
    old = F.col("fired_at") < cutoff
    return events.where(~old), events.agg(F.count_if(old).alias("deleted"))


def purge_stored(spark: SparkSession, path: str, now: datetime, keep: str | int = RETENTION) -> int:
    """Delete events past the retention time from the stored history; returns how many.

    Days that have ended before it go as folders; only the day it falls in is read and written anew, aside, and then switched: a stop at any point loses
    no event that is to stay. Events without a time stay.
    """
    finish_swaps(spark, path, "fired_on")
    cutoff = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - duration_us(keep))
    history = spark.read.parquet(path)
    old = history.where((F.col("fired_on") <= F.to_date(cutoff)) & (F.col("fired_at") < cutoff))
    deleted = old.count()
    if deleted:
        edge = history.where(F.col("fired_on") == F.to_date(cutoff))
        kept = stored(edge.where(F.col("fired_at") >= cutoff))
        replace_days(spark, path, "fired_on", kept, [cutoff_day(now, keep)])
        drop_old_days(spark, path, "fired_on", now, keep)
    return deleted


def acknowledge_stored(spark: SparkSession, path: str, ids: DataFrame, now: datetime) -> DataFrame:
    """Acknowledge events of the stored history; returns each asked ``id`` with whether it was ``found``, as ``acknowledge`` does.

    Only the days of events that change are read whole and written anew.
    """
    finish_swaps(spark, path, "fired_on")
    history = spark.read.parquet(path)
    asked = stored(ids.select("id").distinct())
    open_ones = stored(history.where("acknowledged_at IS NULL").join(asked, "id", "left_semi").select("id", "fired_on"))
    found = {r.fired_on for r in open_ones.select("fired_on").distinct().collect()}
    if found:
        dated = [d for d in found if d is not None]
        touched = history.where(F.col("fired_on").isin(dated) | (F.col("fired_on").isNull() if None in found else F.lit(False)))
        days = [UNDATED if d is None else d.isoformat() for d in found]
        replace_days(spark, path, "fired_on", acknowledge(touched, asked, now)[0], sorted(days))
    return asked.join(open_ones.select("id", F.lit(True).alias("found")).distinct(), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
