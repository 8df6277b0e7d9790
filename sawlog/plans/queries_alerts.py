"""Rules, alerts and the alert history."""

from datetime import datetime

from pyspark.sql import functions as F

from sawlog.functions.jsonfmt import alert_json
from sawlog.functions.text import alert_email_body, alert_email_subject, render_alert
from sawlog.operators.alerts import (
    alert_candidates, alerts_total, apply_cooldown, error_rate_alerts, evaluate_alerts, recent_events, rule_stats, rule_status,
)
from sawlog.operators.history import acknowledge, list_alert_events, purge_older
from sawlog.operators.matching import health_rule_match, match_rules
from sawlog.operators.health import health_transitions
from sawlog.plans.catalog import query
from sawlog.plans.queries_health import TRANSITIONS_SQL
from sawlog.plans.queries_parse import AUTO_VIEWS
from sawlog.plans.triage import triage
from sawlog.plans.views import (
    ALERT_HISTORY_SQL, HEALTH_EVENTS_SQL, LOG_LINES_SQL, RULES_SQL, alert_history, health_events, log_lines, raw_lines,
    rules_table, table,
)

RANK_SQL = "CASE {0} WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 WHEN 'error' THEN 3 WHEN 'fatal' THEN 4 END"
_LINE_RANK = RANK_SQL.format("l.level")
MATCHED_SQL = f"""
matched AS (
  SELECT r.no, r.name, r.type, r.severity, r.threshold, r.window_us, r.cooldown_us, l.*
  FROM {{lines}} l JOIN rules r ON (r.source IS NULL OR r.source = l.source) AND CASE r.type
    WHEN 'pattern' THEN regexp_matches(l.message, r.pattern)
    WHEN 'level' THEN {_LINE_RANK} >= {RANK_SQL.format("lower(r.level)")}
    WHEN 'error_rate' THEN {_LINE_RANK} >= 3 ELSE false END)"""
# A fire chain per rule over row numbers: the next fire is the first full window enough rows on.
RATE_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, line_id) AS rn FROM matched WHERE type = 'error_rate'),
hot AS (
  SELECT a.*, to_microseconds(a.window_us) AS win FROM ranked a JOIN ranked b
    ON a.name = b.name AND b.rn = a.rn - a.threshold + 1 AND a.ts - b.ts <= to_microseconds(a.window_us)),
fires AS (
  SELECT name, threshold, min(rn) AS rn FROM hot GROUP BY name, threshold
  UNION ALL
  SELECT f.name, f.threshold, (SELECT min(h.rn) FROM hot h WHERE h.name = f.name AND h.rn >= f.rn + f.threshold) AS rn
  FROM fires f WHERE f.rn IS NOT NULL),
rate_fires AS (
  SELECT h.* FROM hot h JOIN fires f ON h.name = f.name AND h.rn = f.rn)"""
# The rule as written: errors out of the window are dropped, the new one is counted, and a full count fires and empties it.
RATE_STEPS_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, line_id) AS rn FROM matched WHERE type = 'error_rate'),
steps AS (
  SELECT DISTINCT name, 0::BIGINT AS rn, []::TIMESTAMP[] AS counted, false AS fires FROM numbered
  UNION ALL
  SELECT name, rn, CASE WHEN len(held) + 1 >= threshold THEN [] ELSE list_append(held, ts) END, len(held) + 1 >= threshold
  FROM (
    SELECT n.*, list_filter(s.counted, lambda x: x >= n.ts - to_microseconds(n.window_us)) AS held
    FROM steps s JOIN numbered n ON n.name = s.name AND n.rn = s.rn + 1)),
rate_fires AS (SELECT n.* FROM numbered n JOIN steps s ON s.name = n.name AND s.rn = n.rn WHERE s.fires)"""
DURATION_SQL = "(window_us // 3600000000) || 'h0m0s'"
CANDIDATES_SQL = f"""
candidates AS (
  SELECT name AS rule_name, severity, CASE type WHEN 'pattern' THEN 'Pattern matched: ' || message
      ELSE '[' || upper(level) || '] ' || message END AS message, source, 0 AS count, ts AS fired_at, line_id, cooldown_us
  FROM matched WHERE type <> 'error_rate'
  UNION ALL
  SELECT name, severity, 'Error rate exceeded: ' || threshold || ' errors in ' || {DURATION_SQL}, source, threshold, ts,
    line_id, cooldown_us FROM rate_fires)"""
COOLDOWN_SQL = """
allowed AS (
  SELECT rule_name, cooldown_us, min(fired_at) AS t FROM candidates WHERE cooldown_us > 0 GROUP BY rule_name, cooldown_us
  UNION ALL
  SELECT a.rule_name, a.cooldown_us, (SELECT min(c.fired_at) FROM candidates c WHERE c.rule_name = a.rule_name
      AND c.fired_at >= a.t + to_microseconds(a.cooldown_us)) AS t
  FROM allowed a WHERE a.t IS NOT NULL),
fired AS (
  SELECT c.* FROM candidates c JOIN (SELECT rule_name, t FROM allowed WHERE t IS NOT NULL) a
    ON c.rule_name = a.rule_name AND c.fired_at = a.t
  UNION ALL SELECT * FROM candidates WHERE cooldown_us <= 0)"""
ALERT_VIEWS = (LOG_LINES_SQL, RULES_SQL, MATCHED_SQL.format(lines="log_lines"), RATE_SQL, CANDIDATES_SQL, COOLDOWN_SQL)


@query("j1_match_rules", "SELECT line_id, source, level, message, no AS rule_no, name AS rule_name FROM matched",
       LOG_LINES_SQL, RULES_SQL, MATCHED_SQL.format(lines="log_lines"))
def j1_match_rules(spark, sf_dir):
    return match_rules(log_lines(spark, sf_dir), rules_table(spark)).select(
        "line_id", "source", "level", "message", "rule_no", "rule_name"
    )


@query("w2_error_rate_alerts", f"""
SELECT name AS rule_name, line_id, source, threshold AS count, ts AS fired_at,
  'Error rate exceeded: ' || threshold || ' errors in ' || {DURATION_SQL} AS message FROM rate_fires""",
       *ALERT_VIEWS[:3], RATE_STEPS_SQL, recursive=True)
def w2_error_rate_alerts(spark, sf_dir):
    return error_rate_alerts(log_lines(spark, sf_dir), rules_table(spark)).select(
        "rule_name", "line_id", "source", "count", "fired_at", "message"
    )


@query("w3_apply_cooldown", """
WITH RECURSIVE keyed AS (SELECT event_type AS rule_name, event_id AS line_id, ts AS fired_at FROM events),
allowed AS (
  SELECT rule_name, min(fired_at) AS t FROM keyed GROUP BY rule_name
  UNION ALL
  SELECT a.rule_name, (SELECT min(k.fired_at) FROM keyed k WHERE k.rule_name = a.rule_name
      AND k.fired_at >= a.t + INTERVAL 1 HOUR) AS t FROM allowed a WHERE a.t IS NOT NULL)
SELECT k.rule_name, k.line_id, k.fired_at FROM keyed k JOIN allowed a ON k.rule_name = a.rule_name AND k.fired_at = a.t""")
def w3_apply_cooldown(spark, sf_dir):
    fires = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("rule_name"), F.col("event_id").alias("line_id"), F.col("ts").alias("fired_at"),
        F.lit(3_600_000_000).cast("bigint").alias("cooldown_us"),
    )
    return apply_cooldown(fires).select("rule_name", "line_id", "fired_at")


@query("w4_evaluate_alerts", """
SELECT sha256(concat_ws('|', rule_name, epoch_us(fired_at)::VARCHAR, line_id::VARCHAR)) AS id, rule_name, severity, message,
  source, count, fired_at, NULL::TIMESTAMP AS acknowledged_at FROM fired""", *ALERT_VIEWS, recursive=True)
def w4_evaluate_alerts(spark, sf_dir):
    return evaluate_alerts(log_lines(spark, sf_dir), rules_table(spark))


@query("alert_candidates", "SELECT rule_name, count, line_id, fired_at FROM candidates", *ALERT_VIEWS[:5], recursive=True)
def candidates(spark, sf_dir):
    return alert_candidates(log_lines(spark, sf_dir), rules_table(spark)).select("rule_name", "count", "line_id", "fired_at")


@query("a2_alerts_total", "SELECT rule_name, severity, count(*) AS total FROM fired GROUP BY rule_name, severity",
       *ALERT_VIEWS, recursive=True)
def a2_alerts_total(spark, sf_dir):
    return alerts_total(evaluate_alerts(log_lines(spark, sf_dir), rules_table(spark)))


@query("a3_rule_stats", """
SELECT rule_name, count(*) AS fire_count, max(fired_at) AS last_fired FROM alert_history GROUP BY rule_name""", ALERT_HISTORY_SQL)
def a3_rule_stats(spark, sf_dir):
    return rule_stats(alert_history(spark, sf_dir))


@query("j2_rule_status", """
SELECT r.name, r.type, count(f.rule_name) AS fire_count, max(f.fired_at) AS last_fired
FROM rules r LEFT JOIN fired f ON f.rule_name = r.name GROUP BY r.name, r.type""", *ALERT_VIEWS, recursive=True)
def j2_rule_status(spark, sf_dir):
    rules = rules_table(spark)
    events = evaluate_alerts(log_lines(spark, sf_dir), rules)
    return rule_status(rules, events).select("name", "type", "fire_count", "last_fired")


@query("j5_health_rule_match", """
SELECT r.name AS rule_name, r.severity, t.message, t.source, 0 AS count, t.ts AS fired_at, t.seq
FROM transitions t JOIN rules r ON r.type = 'health_change' AND (r.source IS NULL OR r.source = t.source)""",
       HEALTH_EVENTS_SQL, TRANSITIONS_SQL, RULES_SQL)
def j5_health_rule_match(spark, sf_dir):
    matched = health_rule_match(health_transitions(health_events(spark, sf_dir)), rules_table(spark))
    return matched.select("rule_name", "severity", "message", "source", "count", "fired_at", "seq")


@query("w7_recent_events", """
SELECT id, rule_name, source, fired_at FROM alert_history ORDER BY fired_at DESC, id DESC LIMIT 100""", ALERT_HISTORY_SQL)
def w7_recent_events(spark, sf_dir):
    return recent_events(alert_history(spark, sf_dir)).select("id", "rule_name", "source", "fired_at")


@query("f9_list_alert_events", """
SELECT id, rule_name, severity, message, source, count, fired_at, acknowledged_at FROM alert_history
WHERE severity = 'warning' AND source = 'svc-1' AND fired_at >= '2024-01-05' AND fired_at <= '2024-01-20'
ORDER BY fired_at DESC, id DESC LIMIT 50 OFFSET 20""", ALERT_HISTORY_SQL)
def f9_list_alert_events(spark, sf_dir):
    return list_alert_events(
        alert_history(spark, sf_dir), severity="warning", source="svc-1", start=datetime(2024, 1, 5),
        end=datetime(2024, 1, 20), limit=50, offset=20,
    )


@query("l2_paging", """
SELECT id, rule_name, fired_at FROM alert_history ORDER BY fired_at DESC, id DESC LIMIT 100""", ALERT_HISTORY_SQL)
def l2_paging(spark, sf_dir):
    return list_alert_events(alert_history(spark, sf_dir)).select("id", "rule_name", "fired_at")


@query("u3_purge_older", """
SELECT rule_name, count(*) FILTER (fired_at >= TIMESTAMP '2024-01-11') AS kept,
  (SELECT count(*) FROM alert_history WHERE fired_at < TIMESTAMP '2024-01-11') AS deleted
FROM alert_history GROUP BY rule_name HAVING kept > 0""", ALERT_HISTORY_SQL)
def u3_purge_older(spark, sf_dir):
    kept, deleted = purge_older(alert_history(spark, sf_dir), datetime(2024, 2, 10))
    counts = kept.groupBy("rule_name").agg(F.count("*").alias("kept"))
    return counts.withColumn("deleted", deleted.select("deleted").scalar())


@query("u4_acknowledge", """
, asked AS (SELECT DISTINCT sha256((event_id * 2)::VARCHAR) AS id FROM events)
SELECT h.id, CASE WHEN h.acknowledged_at IS NULL AND a.id IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE h.acknowledged_at END
  AS acknowledged_at, a.id IS NOT NULL AND h.acknowledged_at IS NULL AS found
FROM alert_history h LEFT JOIN asked a ON h.id = a.id""", ALERT_HISTORY_SQL)
def u4_acknowledge(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.sha2((F.col("event_id") * 2).cast("string"), 256).alias("id"))
    updated, found = acknowledge(alert_history(spark, sf_dir), ids, datetime(2024, 3, 1))
    return updated.join(found, "id", "left").select(
        "id", "acknowledged_at", F.coalesce("found", F.lit(False)).alias("found")
    )


@query("o23_render_alert", """
SELECT id, CASE severity WHEN 'critical' THEN '[ALERT][CRITICAL] ' ELSE '[ALERT][WARNING] ' END || rule_name || ': ' || message
  || ' (source: ' || source || ')' AS line FROM alert_history""", ALERT_HISTORY_SQL)
def o23_render_alert(spark, sf_dir):
    c = F.col
    return alert_history(spark, sf_dir).select(
        "id", render_alert(c("severity"), c("rule_name"), c("message"), c("source")).alias("line")
    )


@query("o24_render_alert_email", """
SELECT id, '[Sawlog][' || upper(severity) || '] ' || rule_name AS subject,
  'Rule: ' || rule_name || chr(10) || 'Severity: ' || severity || chr(10) || 'Source: ' || source || chr(10) || 'Time: '
  || strftime(fired_at, '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10) || chr(10) || message
  || CASE WHEN count > 0 THEN chr(10) || 'Count: ' || count ELSE '' END AS body FROM alert_history""", ALERT_HISTORY_SQL)
def o24_render_alert_email(spark, sf_dir):
    c = F.col
    return alert_history(spark, sf_dir).select(
        "id", alert_email_subject(c("severity"), c("rule_name")).alias("subject"),
        alert_email_body(c("rule_name"), c("severity"), c("source"), c("fired_at"), c("message"), c("count")).alias("body"),
    )


@query("o25_alert_json", """
SELECT id, '{"rule":"' || rule_name || '","severity":"' || severity || '","message":"' || message || '","source":"' || source
  || '","timestamp":"' || strftime(fired_at, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(fired_at, '.%f'), '0'), '.') || 'Z"'
  || CASE WHEN count <> 0 THEN ',"count":' || count ELSE '' END || '}' AS body FROM alert_history""", ALERT_HISTORY_SQL)
def o25_alert_json(spark, sf_dir):
    c = F.col
    return alert_history(spark, sf_dir).select(
        "id", alert_json(c("rule_name"), c("severity"), c("message"), c("source"), c("fired_at"), c("count")).alias("body")
    )


# The triage query sees messages 'user <type>', so the anchored patterns of the rules match less there.
@query("triage", """
, shown AS (SELECT * FROM auto_lines WHERE level IN ('warn','error','fatal') AND regexp_matches(message, 'user')),
anchors AS (
  SELECT source, level, message, min(ts) AS t FROM shown GROUP BY source, level, message
  UNION ALL
  SELECT a.source, a.level, a.message, (SELECT min(l.ts) FROM shown l WHERE l.source = a.source AND l.level = a.level
      AND l.message = a.message AND l.ts > a.t + INTERVAL 1 HOUR) AS t
  FROM anchors a WHERE a.t IS NOT NULL)
SELECT s.source, s.level, s.lines, e.entries, coalesce(f.alerts, 0) AS alerts, f.last_alert
FROM (SELECT source, level, count(*) AS lines FROM shown GROUP BY source, level) s
JOIN (SELECT source, level, count(*) AS entries FROM anchors WHERE t IS NOT NULL GROUP BY source, level) e
  ON s.source = e.source AND s.level = e.level
LEFT JOIN (SELECT source, count(*) AS alerts, max(fired_at) AS last_alert FROM fired GROUP BY source) f ON f.source = s.source
""", *AUTO_VIEWS, RULES_SQL, MATCHED_SQL.format(lines="auto_lines"), RATE_SQL, CANDIDATES_SQL, COOLDOWN_SQL, recursive=True)
def triage_query(spark, sf_dir):
    return triage(raw_lines(spark, sf_dir), rules_table(spark), "warn", "user")
