"""Filters, searches, metrics, windows and batches over log lines."""

from pyspark.sql import functions as F

from sawlog.functions.jsonfmt import log_json
from sawlog.functions.text import format_line
from sawlog.operators.batching import batch_records, bulk_bodies, webhook_payloads
from sawlog.operators.collapse import collapse_repeats
from sawlog.operators.filters import (
    filter_level, filter_logs, filter_regex, run_saved_search, run_saved_searches, search_logs, subscribe, webhook_min_level,
)
from sawlog.operators.metrics import known_sources, latency_histogram, latest_logs, level_summary, logs_total
from sawlog.operators.parse import parse_auto
from sawlog.plans.catalog import query
from sawlog.plans.queries_parse import AUTO_VIEWS
from sawlog.plans.views import LOG_LINES_SQL, log_lines, raw_lines, saved_searches, table

LINE = ["line_id", "ts", "level", "message", "source"]
RANK_SQL = "CASE lower(level) WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 WHEN 'error' THEN 3 WHEN 'fatal' THEN 4 END"

# Lines as no parser makes them: levels in other cases and unknown ones.
ODD_SQL = """
odd_lines AS (
  SELECT line_id, ts, message, source,
    CASE line_id % 6 WHEN 0 THEN upper(level) WHEN 1 THEN 'notice' WHEN 2 THEN 'Fatal' ELSE level END AS level
  FROM log_lines)"""


def _odd(spark, sf_dir):
    n = F.col("line_id") % 6
    odd = F.when(n == 0, F.upper("level")).when(n == 1, "notice").when(n == 2, "Fatal").otherwise(F.col("level"))
    return log_lines(spark, sf_dir).withColumn("level", odd).select(*LINE)


@query("f1_filter_level", f"""
SELECT line_id, ts, level, message, source FROM odd_lines WHERE {RANK_SQL} IS NULL OR {RANK_SQL} >= 2""", LOG_LINES_SQL, ODD_SQL)
def f1_filter_level(spark, sf_dir):
    return filter_level(_odd(spark, sf_dir), "WARN")


@query("f2_filter_regex", r"""
SELECT line_id, ts, level, message, source FROM log_lines WHERE regexp_matches(message, '(?i)^[[:alpha:]]*R(chase|or)?$')""", LOG_LINES_SQL)
def f2_filter_regex(spark, sf_dir):
    return filter_regex(log_lines(spark, sf_dir), r"(?i)^[[:alpha:]]*R(chase|or)?$").select(*LINE)


@query("f2_filter_regex_documents", r"""
SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?m)^[A-Z]\w+\s+\w+\.$')""")
def f2_filter_regex_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    return filter_regex(docs, r"(?m)^[A-Z]\w+\s+\w+\.$").select("doc_id", "lang")


@query("f3_filter_logs", f"""
SELECT line_id, ts, level, message, source FROM odd_lines
WHERE ({RANK_SQL} IS NULL OR {RANK_SQL} >= 1) AND regexp_matches(message, 'err|view')""", LOG_LINES_SQL, ODD_SQL)
def f3_filter_logs(spark, sf_dir):
    return filter_logs(_odd(spark, sf_dir), "info", "err|view")


@query("f4_subscribe", """
SELECT line_id, ts, level, message, source FROM odd_lines
WHERE source = 'svc-2' AND (level NOT IN ('debug','info') )""", LOG_LINES_SQL, ODD_SQL)
def f4_subscribe(spark, sf_dir):
    return subscribe(_odd(spark, sf_dir), "warn", "svc-2")


@query("f5_search_logs", """
SELECT line_id, ts, level, message, source FROM odd_lines
WHERE lower(level) IN ('error','fatal','notice') AND source IN ('svc-0','svc-4') AND regexp_matches(message, '(?i)E[RV]')""",
       LOG_LINES_SQL, ODD_SQL)
def f5_search_logs(spark, sf_dir):
    return search_logs(_odd(spark, sf_dir), ["error", "fatal", "notice"], ["svc-0", "svc-4"], "E[RV]")


@query("f6_run_saved_search", """
SELECT line_id, ts, level, message, source FROM log_lines
WHERE level IN ('error','warn') AND regexp_matches(message, '(?i)PUR|ERR')""", LOG_LINES_SQL)
def f6_run_saved_search(spark, sf_dir):
    return run_saved_search(log_lines(spark, sf_dir), saved_searches(spark), "failures").select(*LINE)


@query("f6_run_saved_searches", """
SELECT search, source, count(*) AS lines FROM (
  SELECT 'all' AS search, * FROM log_lines UNION ALL SELECT 'broken', * FROM log_lines WHERE level = 'warn'
  UNION ALL SELECT 'failures', * FROM log_lines WHERE level IN ('error','warn') AND regexp_matches(message, '(?i)PUR|ERR')
  UNION ALL SELECT 'two-services', * FROM log_lines WHERE source IN ('svc-1','svc-3')) GROUP BY search, source""", LOG_LINES_SQL)
def f6_run_saved_searches(spark, sf_dir):
    found = run_saved_searches(log_lines(spark, sf_dir), saved_searches(spark))
    return found.groupBy("search", "source").agg(F.count("*").alias("lines"))


@query("f7_webhook_min_level", f"""
SELECT line_id, ts, level, message, source FROM odd_lines WHERE coalesce({RANK_SQL}, 0) >= 1""", LOG_LINES_SQL, ODD_SQL)
def f7_webhook_min_level(spark, sf_dir):
    return webhook_min_level(_odd(spark, sf_dir), "info")


@query("a1_logs_total", """
SELECT source, level, count(*) AS total FROM auto_lines GROUP BY source, level""", *AUTO_VIEWS)
def a1_logs_total(spark, sf_dir):
    return logs_total(parse_auto(raw_lines(spark, sf_dir)))


@query("errors_by_source", """
SELECT source, count(*) AS errors FROM auto_lines
WHERE level IN ('warn','error','fatal') AND regexp_matches(message, 'user (err|pur)') GROUP BY source""", *AUTO_VIEWS)
def errors_by_source(spark, sf_dir):
    kept = filter_logs(parse_auto(raw_lines(spark, sf_dir)), "warn", "user (err|pur)")
    return kept.groupBy("source").agg(F.count("*").alias("errors"))


@query("a7_latency_histogram", """
SELECT source, le, count(*) FILTER (us <= le * 1000000) AS count FROM (
  SELECT 'svc-' || (user_id % 5) AS source, (value * 10000)::BIGINT AS us FROM events),
  (SELECT unnest([0.005,0.01,0.025,0.05,0.1,0.25,0.5,1,2.5,5,10,'inf'::DOUBLE])::DOUBLE AS le) GROUP BY source, le""")
def a7_latency_histogram(spark, sf_dir):
    late = F.round(F.col("value") * 10_000).cast("bigint")
    lines = table(spark, sf_dir, "events").select(
        F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("source"), "ts",
        F.timestamp_micros(F.unix_micros("ts") + late).alias("ingest_ts"),
    )
    return latency_histogram(lines)


LEVELS_TEXT_SQL = """
  SELECT batch, sum(n)::BIGINT AS count,
    string_agg(n || ' ' || upper(level), ', ' ORDER BY CASE level WHEN 'error' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC) AS parts
  FROM (SELECT batch, level, count(*) AS n FROM batched GROUP BY batch, level) GROUP BY batch"""
BATCHED_SQL = """
batched AS (SELECT *, (row_number() OVER (ORDER BY line_id) - 1) // {size} AS batch FROM log_lines {where})"""


@query("a9_level_summary", f"""
SELECT batch, count, count || ' log(s) — ' || parts AS text FROM ({LEVELS_TEXT_SQL})""",
       LOG_LINES_SQL, BATCHED_SQL.format(size=10, where=""))
def a9_level_summary(spark, sf_dir):
    return level_summary(batch_records(log_lines(spark, sf_dir), 10)).select("batch", "count", "text")


@query("a10_known_sources", "SELECT DISTINCT source FROM log_lines", LOG_LINES_SQL)
def a10_known_sources(spark, sf_dir):
    return known_sources(log_lines(spark, sf_dir))


@query("w1_collapse_repeats", """
, anchors AS (
  SELECT source, level, message, min(ts) AS t FROM log_lines GROUP BY source, level, message
  UNION ALL
  SELECT a.source, a.level, a.message, (SELECT min(l.ts) FROM log_lines l WHERE l.source = a.source AND l.level = a.level
      AND l.message = a.message AND l.ts > a.t + INTERVAL 1 HOUR) AS t
  FROM anchors a WHERE a.t IS NOT NULL),
entries AS (
  SELECT a.source, a.level, a.message, count(*) AS count, a.t AS first_seen, max(l.ts) AS last_seen,
    min_by(l.line_id, l.ts) AS line_id
  FROM anchors a JOIN log_lines l ON l.source = a.source AND l.level = a.level AND l.message = a.message
    AND l.ts BETWEEN a.t AND a.t + INTERVAL 1 HOUR
  WHERE a.t IS NOT NULL GROUP BY a.source, a.level, a.message, a.t),
timed AS (SELECT *, date_diff('microsecond', first_seen, last_seen) AS us FROM entries)
SELECT line_id, source, level, count, first_seen, last_seen,
  message || CASE WHEN count >= 2 THEN ' (x' || count || ' in last ' ||
    CASE WHEN us < 1000000 THEN (us // 1000) || 'ms' WHEN us < 60000000 THEN (us // 1000000) || 's'
      WHEN us // 1000000 % 60 = 0 THEN (us // 60000000) || 'm'
      ELSE (us // 60000000) || 'm' || (us // 1000000 % 60) || 's' END || ')' ELSE '' END AS message
FROM timed""", LOG_LINES_SQL, recursive=True)
def w1_collapse_repeats(spark, sf_dir):
    out = collapse_repeats(log_lines(spark, sf_dir), "1h")
    return out.select("line_id", "source", "level", "count", "first_seen", "last_seen", "message")


@query("w8_latest_logs", """
SELECT line_id, ts, level, message, source FROM log_lines ORDER BY line_id DESC LIMIT 2500""", LOG_LINES_SQL)
def w8_latest_logs(spark, sf_dir):
    return latest_logs(log_lines(spark, sf_dir), 2500).select(*LINE)


@query("w9_batch_records", """
SELECT batch, count(*) AS docs, min(line_id) AS first_id, max(line_id) AS last_id FROM batched GROUP BY batch""",
       LOG_LINES_SQL, BATCHED_SQL.format(size=500, where=""))
def w9_batch_records(spark, sf_dir):
    return batch_records(log_lines(spark, sf_dir), 500).groupBy("batch").agg(
        F.count("*").alias("docs"), F.min("line_id").alias("first_id"), F.max("line_id").alias("last_id")
    )


@query("k1_format_line", """
SELECT line_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || source || '] ' || upper(level) || ': ' || message AS line
FROM log_lines""", LOG_LINES_SQL)
def k1_format_line(spark, sf_dir):
    c = F.col
    return log_lines(spark, sf_dir).select(
        "line_id", format_line(c("ts"), c("source"), c("level"), c("message")).alias("line")
    )


_TS_JSON = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z'"
DOC_SQL = f"""'{{"timestamp":"' || {_TS_JSON} || '","level":"' || level || '","message":"' || message
  || '","source":"' || source || '"}}'"""


@query("k2_ndjson", f"SELECT line_id, {DOC_SQL} AS line FROM log_lines", LOG_LINES_SQL)
def k2_ndjson(spark, sf_dir):
    c, none = F.col, F.create_map().cast("map<string,variant>")
    return log_lines(spark, sf_dir).select(
        "line_id", log_json(c("ts"), c("level"), c("message"), c("source"), none).alias("line")
    )


@query("k4_bulk_bodies", f"""
SELECT batch, count(*) AS docs, string_agg('{{"index":{{"_index":"logs-' || strftime(ts, '%Y.%m.%d') || '"}}}}' || chr(10)
  || {DOC_SQL} || chr(10), '' ORDER BY line_id) AS bulk_body
FROM batched GROUP BY batch""", LOG_LINES_SQL, BATCHED_SQL.format(size=500, where=""))
def k4_bulk_bodies(spark, sf_dir):
    return bulk_bodies(log_lines(spark, sf_dir), "logs-%{+YYYY.MM.dd}")


@query("k5_webhook_payloads", f"""
SELECT t.batch, t.count, '{{"text":"Sawlog: ' || t.count || ' log(s) — ' || parts || '","logs":[' || logs || '],"count":' || t.count
  || ',"sent_at":"2024-02-01T00:00:00Z"}}' AS payload
FROM ({LEVELS_TEXT_SQL}) t JOIN (
  SELECT batch, string_agg('{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"' || upper(level)
    || '","message":"' || message || '","source":"' || source || '"}}', ',' ORDER BY line_id) AS logs
  FROM batched GROUP BY batch) l ON t.batch = l.batch""",
       LOG_LINES_SQL, BATCHED_SQL.format(size=10, where="WHERE level IN ('warn','error')"))
def k5_webhook_payloads(spark, sf_dir):
    sent = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return webhook_payloads(log_lines(spark, sf_dir), sent, "warn").drop("first_id", "last_id")
