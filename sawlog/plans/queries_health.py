"""Source health."""

from pyspark.sql import functions as F

from sawlog.operators.health import (
    active_sources, all_healthy, health_counts, health_current, health_summary_line, health_transitions,
    source_errors_total, source_gauges,
)
from sawlog.operators.filters import filter_status
from sawlog.plans.catalog import query
from sawlog.plans.views import HEALTH_EVENTS_SQL, health_events

TRANSITIONS_SQL = """
transitions AS (
  SELECT source, ts, seq, old_status, status AS new_status,
    'Source "' || source || '" health changed: ' || old_status || ' -> ' || status AS message
  FROM (SELECT *, coalesce(lag(CASE WHEN kind = 'register' THEN 'starting' ELSE status END)
      OVER (PARTITION BY source ORDER BY ts, seq), '') AS old_status FROM health_events)
  WHERE kind = 'status' AND old_status <> status)"""
# Finer sources than the five services, so that all states occur among the current ones.
FINE_SQL = HEALTH_EVENTS_SQL.replace("(user_id % 5)", "user_id")
CURRENT_SQL = """
epochs AS (
  SELECT *, count(*) FILTER (kind = 'register') OVER (PARTITION BY source ORDER BY ts, seq) AS epoch FROM health_events),
current AS (
  SELECT source, max_by(CASE WHEN kind = 'register' THEN 'starting' ELSE status END, seq) AS status,
    max_by(error, seq) FILTER (error IS NOT NULL) AS last_error, max(ts) AS last_update, count(error) AS error_count,
    min(ts) AS start_time
  FROM (SELECT *, max(epoch) OVER (PARTITION BY source) AS newest FROM epochs) WHERE epoch = newest GROUP BY source)"""
VIEWS = (FINE_SQL, CURRENT_SQL)


def _events(spark, sf_dir):
    fine = F.concat(F.lit("svc-"), F.col("user_id").cast("string"))
    return health_events(spark, sf_dir, source=fine)


def _current(spark, sf_dir):
    return health_current(_events(spark, sf_dir))


@query("w5_health_transitions", "SELECT source, ts, seq, old_status, new_status, message FROM transitions",
       HEALTH_EVENTS_SQL, TRANSITIONS_SQL)
def w5_health_transitions(spark, sf_dir):
    return health_transitions(health_events(spark, sf_dir))


@query("w6_health_current", "SELECT source, status, last_error, last_update, error_count, start_time FROM current", *VIEWS)
def w6_health_current(spark, sf_dir):
    return _current(spark, sf_dir)


@query("f8_filter_status", "SELECT source, error_count FROM current WHERE status = 'failed'", *VIEWS)
def f8_filter_status(spark, sf_dir):
    return filter_status(_current(spark, sf_dir), "failed").select("source", "error_count")


COUNTS_SQL = """
  SELECT count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'stopped') AS stopped, count(*) AS total_all
  FROM current"""


@query("a4_health_counts", f"""
SELECT *, healthy + degraded + failed + stopped AS total_reported,
  CASE WHEN failed > 0 THEN 'unhealthy' WHEN degraded > 0 THEN 'degraded' ELSE 'healthy' END AS overall
FROM ({COUNTS_SQL})""", *VIEWS)
def a4_health_counts(spark, sf_dir):
    return health_counts(_current(spark, sf_dir))


@query("a5_all_healthy", "SELECT coalesce(bool_and(status = 'healthy'), true) AS all_healthy FROM current", *VIEWS)
def a5_all_healthy(spark, sf_dir):
    return all_healthy(_current(spark, sf_dir))


@query("a6_source_gauges", """
SELECT source, g.status, (g.status = c.status)::INTEGER AS value
FROM current c, (VALUES ('healthy'), ('degraded'), ('failed'), ('stopped'), ('starting')) g(status)
WHERE g.status <> 'starting' OR c.status = 'starting'""", *VIEWS)
def a6_source_gauges(spark, sf_dir):
    return source_gauges(_current(spark, sf_dir))


@query("a6_active_sources", "SELECT count(*) FILTER (status IN ('healthy','degraded','failed')) AS active FROM current", *VIEWS)
def a6_active_sources(spark, sf_dir):
    return active_sources(_current(spark, sf_dir))


@query("a8_source_errors_total", "SELECT source, count(error) AS errors FROM health_events WHERE kind = 'status' GROUP BY source",
       FINE_SQL)
def a8_source_errors_total(spark, sf_dir):
    return source_errors_total(_events(spark, sf_dir))


@query("a12_health_summary_line", f"""
SELECT 'Sources: ' || total_all || ' total | ✓ ' || healthy || ' healthy | ⚠ ' || degraded || ' degraded | ✗ ' || failed
  || ' failed | ⏸ ' || stopped || ' stopped' AS summary FROM ({COUNTS_SQL})""", *VIEWS)
def a12_health_summary_line(spark, sf_dir):
    return health_summary_line(_current(spark, sf_dir))
