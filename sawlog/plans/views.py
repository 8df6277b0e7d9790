"""Log-shaped views of the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sawlog.schema import RULE_SCHEMA

LEVEL_BY_TYPE = {"error": "error", "purchase": "warn", "signup": "info", "click": "info", "view": "debug"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Times without a zone are UTC; the session runs in UTC.
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def event_level() -> Column:
    level = F
    for kind, name in LEVEL_BY_TYPE.items():
        level = level.when(F.col("event_type") == kind, F.lit(name))
    return level.otherwise(F.lit("info"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw lines in four formats, one in four each."""
    e = table(spark, sf_dir, "events").withColumn("level", event_level())
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level, upper = F.col("level"), F.upper("level")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(
            F.lit('{"timestamp":"'), iso, F.lit('","level":"'), level, F.lit('","message":"user '),
            F.col("event_type"), F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")))
        .when(F.col("event_id") % 4 == 1, F.concat(
            F.lit("time="), iso, F.lit(" level="), level, F.lit(' msg="user '), F.col("event_type"),
            F.lit('" user='), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 4 == 2, F.concat(
            F.lit("["), plain, F.lit("] "), upper, F.lit(": user "), F.col("event_type")))
        .otherwise(F.concat(upper, F.lit(": user "), F.col("event_type")))
    )
    return e.select(
        F.col("event_id").alias("line_id"), F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("source"),
        raw.alias("raw"), F.col("ts").alias("ingest_ts"),
    )


RAW_LINES_SQL = """
raw_lines AS (
  SELECT event_id AS line_id, 'svc-' || (user_id % 5) AS source, ts AS ingest_ts,
    CASE event_id % 4
      WHEN 0 THEN '{"timestamp":"' || iso || '","level":"' || lvl || '","message":"user ' || event_type
                  || '","user":' || user_id || ',"props":' || props || '}'
      WHEN 1 THEN 'time=' || iso || ' level=' || lvl || ' msg="user ' || event_type || '" user=' || user_id
      WHEN 2 THEN '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || upper(lvl) || ': user ' || event_type
      ELSE upper(lvl) || ': user ' || event_type END AS raw
  FROM (
    SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug'
        ELSE 'info' END AS lvl
    FROM events))"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as parsed lines: ``line_id, ts, level, message, source``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("line_id"), "ts", event_level().alias("level"),
        F.col("event_type").alias("message"), F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("source"),
    )


LOG_LINES_SQL = """
log_lines AS (
  SELECT event_id AS line_id, ts,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug'
      ELSE 'info' END AS level,
    event_type AS message, 'svc-' || (user_id % 5) AS source
  FROM events)"""


def rules_table(spark: SparkSession) -> DataFrame:
    """The alert rules used on the test tables."""
    return spark.createDataFrame(RULES, RULE_SCHEMA)


HOUR_US = 3_600_000_000
# name, type, severity, pattern, level, source, threshold, window, cooldown
RULES = [
    ("bad-words", "pattern", "critical", "err|pur(ch)", None, None, None, None, HOUR_US),
    ("svc-1-views", "pattern", "warning", "^view$", None, "svc-1", None, None, 0),
    ("errors", "level", "warning", None, "error", None, None, None, HOUR_US),
    ("warn-svc-2", "level", "critical", None, "WARN", "svc-2", None, None, 6 * HOUR_US),
    ("rate", "error_rate", "critical", None, None, None, 20, 6 * HOUR_US, 24 * HOUR_US),
    ("rate-svc-3", "error_rate", "warning", None, None, "svc-3", 3, 2 * HOUR_US, 0),
    ("health", "health_change", "critical", None, None, None, None, None, 0),
    ("health-svc-4", "health_change", "warning", None, None, "svc-4", None, None, 0),
]


def _sql_value(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


RULES_SQL = """
rules(no, name, type, severity, pattern, level, source, threshold, window_us, cooldown_us) AS (VALUES
""" + ",\n".join(
    f"  ({no}, {', '.join(_sql_value(v) for v in rule)})" for no, rule in enumerate(RULES)
) + ")"


def health_events(spark: SparkSession, sf_dir: str, source: Column | None = None) -> DataFrame:
    """``events`` as health events: signup registers, the others set a status."""
    service = F.concat(F.lit("svc-"), F.col("user_id") % 5) if source is None else source
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "failed").when(kind == "view", "degraded").when(kind == "click", "healthy")
        .when(kind == "purchase", "stopped")
    )
    error = F.when(kind == "error", F.concat(F.lit("boom "), F.col("event_id").cast("string"))).when(
        (kind == "view") & (F.col("event_id") % 3 == 0), F.lit("slow")
    )
    return e.select(
        service.alias("source"), "ts", F.col("event_id").alias("seq"),
        F.when(kind == "signup", "register").otherwise("status").alias("kind"), status.alias("status"),
        error.alias("error"),
    )


HEALTH_EVENTS_SQL = """
health_events AS (
  SELECT 'svc-' || (user_id % 5) AS source, ts, event_id AS seq,
    CASE WHEN event_type = 'signup' THEN 'register' ELSE 'status' END AS kind,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'degraded' WHEN 'click' THEN 'healthy'
      WHEN 'purchase' THEN 'stopped' END AS status,
    CASE WHEN event_type = 'error' THEN 'boom ' || event_id
      WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'slow' END AS error
  FROM events)"""


def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as stored alert events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("id"),
        F.concat(F.lit("rule-"), F.col("user_id") % 7).alias("rule_name"),
        F.when(F.col("event_type") == "error", "critical").otherwise("warning").alias("severity"),
        F.concat(F.lit("Pattern matched: "), "event_type").alias("message"),
        F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("source"),
        (F.col("event_id") % 4).alias("count"), F.col("ts").alias("fired_at"),
        F.when(F.col("event_id") % 3 == 0, F.timestamp_micros(F.unix_micros("ts") + HOUR_US)).alias("acknowledged_at"),
    )


ALERT_HISTORY_SQL = """
alert_history AS (
  SELECT sha256(event_id::VARCHAR) AS id, 'rule-' || (user_id % 7) AS rule_name,
    CASE event_type WHEN 'error' THEN 'critical' ELSE 'warning' END AS severity,
    'Pattern matched: ' || event_type AS message, 'svc-' || (user_id % 5) AS source,
    event_id % 4 AS count, ts AS fired_at,
    CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS acknowledged_at
  FROM events)"""

SEARCHES = [
    ("all", "{}"),
    ("broken", '{"regex":"(","levels":["warn"]}'),
    ("failures", '{"levels":["error","warn"],"regex":"PUR|ERR"}'),
    ("two-services", '{"sources":["svc-1","svc-3"]}'),
]


def saved_searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "name string, filters string")
