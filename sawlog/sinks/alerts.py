"""Alert events to notifiers and to the history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.functions.jsonfmt import alert_json
from sawlog.functions.text import alert_email_body, alert_email_subject, render_alert
from sawlog.session import stored
from sawlog.sinks.delivery import send_bodies
from sawlog.sinks.files import finish_swaps

MAX_DAYS = 1000


def alert_bodies(events: DataFrame, kind: str, app: str = "Sawlog") -> DataFrame:
    """``(id, body)`` of each event for ``console``, ``webhook`` or ``email``."""
    c = {name: F.col(name) for name in ("severity", "rule_name", "message", "source", "count", "fired_at")}
    if kind == "console":
        body = render_alert(c["severity"], c["rule_name"], c["message"], c["source"])
    elif kind == "webhook":
        body = alert_json(c["rule_name"], c["severity"], c["message"], c["source"], c["fired_at"], c["count"])
    elif kind == "email":
        body = F.concat(
            F.lit("Subject: "), alert_email_subject(c["severity"], c["rule_name"], app), F.lit("\n\n"),
            alert_email_body(c["rule_name"], c["severity"], c["source"], c["fired_at"], c["message"], c["count"]),
        )
    else:
        raise ValueError(f"unknown notifier {kind!r}")
    return events.select(F.concat(F.lit(f"{kind}-"), "id").alias("id"), body.alias("body"))


def write_alerts(events: DataFrame, targets: list[dict] = ()) -> None:
    """Notify every target of each event; the console when there is none.

    A target has a ``kind`` and, but for the console, the settings of a transport.
    """
    for target in targets or [{"kind": "console"}]:
        settings = dict(target)
        bodies = alert_bodies(events, settings.pop("kind"), settings.pop("app", "Sawlog"))
        if settings:
            send_bodies(bodies, settings)
        else:
            bodies.select("body").write.format("console").option("truncate", "false").save()


def append_alert_events(events: DataFrame, path: str) -> None:
    """Add fired events to the history, a Parquet table partitioned by day.

    Events that are there already, with or without a time, are not added again, so a repeated run is harmless; only the
    days of the new events are read for that: up to ``MAX_DAYS`` by name, more as one range.
    """
    spark = events.sparkSession
    fresh = stored(events.withColumn("fired_on", F.to_date("fired_at")))
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        finish_swaps(spark, path, "fired_on")
        known = known_events(spark, path, fresh).select(F.col("id").alias("_id"), F.col("fired_on").alias("_on"))
        fresh = fresh.join(known, (F.col("id") == F.col("_id")) & F.col("fired_on").eqNullSafe(F.col("_on")), "left_anti")
    fresh.write.mode("append").partitionBy("fired_on").parquet(path)


def known_events(spark: SparkSession, path: str, fresh: DataFrame) -> DataFrame:
    """Ids in the history on the days of ``fresh``; the days are literals, so other partitions are not read."""
    days = [r.fired_on for r in fresh.select("fired_on").where("fired_on IS NOT NULL").distinct().limit(MAX_DAYS + 1).collect()]
    history = spark.read.parquet(path).select("id", "fired_on")
    undated = F.col("fired_on").isNull() if fresh.where("fired_on IS NULL").head(1) else F.lit(False)
    if len(days) <= MAX_DAYS:
        return history.where(F.col("fired_on").isin(days) | undated)
    first, last = fresh.agg(F.min("fired_on"), F.max("fired_on")).first()
    return history.where(F.col("fired_on").between(first, last) | undated)


def read_alert_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
