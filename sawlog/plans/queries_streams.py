"""The streaming operators, run over the test tables until all is read, and then closed.

The input comes in three micro-batches or more, in order of time.
"""

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.operators.metrics import logs_total
from sawlog.plans.catalog import query
from sawlog.plans.queries_alerts import ALERT_VIEWS, DURATION_SQL
from sawlog.plans.queries_health import CURRENT_SQL, FINE_SQL, TRANSITIONS_SQL
from sawlog.plans.queries_parse import AUTO_VIEWS
from sawlog.plans.views import HEALTH_EVENTS_SQL, LOG_LINES_SQL, health_events, log_lines, raw_lines, rules_table, table
from sawlog.session import ROCKSDB, checkpoint_dir
from sawlog.streaming.flush import run_to_end
from sawlog.streaming.reload import ReloadingAlerts
from sawlog.streaming.streams import (
    stream_alerts, stream_collapse, stream_error_rate, stream_health, stream_health_transitions, stream_metrics_by_interval,
    stream_parse, stream_sinks,
)

DELAY = "1 hour"
ROWS_PER_BATCH = 1_000_000
LEAST_ROWS_PER_FILE = 20_000


def _place(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/sawlog-streams/{uuid.uuid4().hex}"


class _StreamingReads:
    """Stands in for the session so that the table views read as streams.

    A table is laid out once, in files of successive slices of time, and as many files are read at a time as there are
    cores, at most ``ROWS_PER_BATCH`` rows or so.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.read = spark, self
        # The stateful streams need this store; the queries are run on any session.
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def parquet(self, path: str) -> DataFrame:
        folder, name = path.rsplit("/", 1)
        rows, place = table(self.spark, folder, name.removesuffix(".parquet")), f"{_place(self.spark)}/in"
        count = rows.count()
        batches = max(3, -(-count // ROWS_PER_BATCH))
        together = max(1, min(self.spark.sparkContext.defaultParallelism, count // batches // LEAST_ROWS_PER_FILE))
        # Rows without a time come first.
        rows.repartitionByRange(batches * together, F.col("ts").asc_nulls_first()).write.parquet(place)
        in_turn(self.spark, place)
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", together).parquet(place)


def in_turn(spark: SparkSession, place: str) -> None:
    """Date the files of a folder a second apart in the order of their names, which is the order a file stream reads them in."""
    root = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    first = int(time.time()) - len(files)
    for no, file in enumerate(files):
        fs.setTimes(file, (first + no) * 1000, -1)


@query("r1_stream_parse", """
SELECT line_id, source, ts, level, message FROM auto_lines WHERE level IN ('warn','error','fatal') AND regexp_matches(message, 'err')""",
       *AUTO_VIEWS)
def r1_stream_parse(spark, sf_dir):
    build = lambda raw: stream_parse(raw, "auto", "warn", "err").select("line_id", "source", "ts", "level", "message")
    place, stream = _place(spark), build(raw_lines(_StreamingReads(spark), sf_dir))
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state")
    writer.trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


@query("r2_stream_collapse", """
, anchors AS (
  SELECT source, level, message, min(ts) AS t FROM log_lines GROUP BY source, level, message
  UNION ALL
  SELECT a.source, a.level, a.message, (SELECT min(l.ts) FROM log_lines l WHERE l.source = a.source AND l.level = a.level
      AND l.message = a.message AND l.ts > a.t + INTERVAL 1 HOUR) AS t
  FROM anchors a WHERE a.t IS NOT NULL)
SELECT min_by(l.line_id, l.ts) AS line_id, a.source, a.level, count(*) AS count, a.t AS first_seen, max(l.ts) AS last_seen
FROM anchors a JOIN log_lines l ON l.source = a.source AND l.level = a.level AND l.message = a.message
  AND l.ts BETWEEN a.t AND a.t + INTERVAL 1 HOUR
GROUP BY a.source, a.level, a.message, a.t""", LOG_LINES_SQL, recursive=True)
def r2_stream_collapse(spark, sf_dir):
    lines = log_lines(_StreamingReads(spark), sf_dir)
    found = run_to_end(lines, lambda s: stream_collapse(s, "1h", delay=DELAY), _place(spark))
    return found.select("line_id", "source", "level", "count", "first_seen", "last_seen")


@query("r3_stream_error_rate", f"""
SELECT name AS rule_name, source, threshold AS count, ts AS fired_at,
  'Error rate exceeded: ' || threshold || ' errors in ' || {DURATION_SQL} AS message FROM rate_fires""",
       *ALERT_VIEWS[:4], recursive=True)
def r3_stream_error_rate(spark, sf_dir):
    lines = log_lines(_StreamingReads(spark), sf_dir)
    found = run_to_end(lines, lambda s: stream_error_rate(s, rules_table(spark), delay=DELAY), _place(spark))
    return found.select("rule_name", "source", "count", "fired_at", "message")


@query("r4_stream_alerts", "SELECT rule_name, source, count, fired_at, message FROM fired", *ALERT_VIEWS, recursive=True)
def r4_stream_alerts(spark, sf_dir):
    lines = log_lines(_StreamingReads(spark), sf_dir)
    found = run_to_end(lines, lambda s: stream_alerts(s, rules_table(spark), delay=DELAY), _place(spark))
    return found.select("rule_name", "source", "count", "fired_at", "message")


@query("r5_stream_health", "SELECT source, ts, seq, old_status, new_status, message FROM transitions", HEALTH_EVENTS_SQL, TRANSITIONS_SQL)
def r5_stream_health(spark, sf_dir):
    events = health_events(_StreamingReads(spark), sf_dir)
    return run_to_end(events, lambda s: stream_health_transitions(s, DELAY), _place(spark))


@query("r5_stream_health_current", "SELECT source, status, last_error, last_update, error_count, start_time FROM current", FINE_SQL, CURRENT_SQL)
def r5_stream_health_current(spark, sf_dir):
    fine = F.concat(F.lit("svc-"), F.col("user_id").cast("string"))
    events = health_events(_StreamingReads(spark), sf_dir, source=fine)
    states = run_to_end(events, lambda s: stream_health(s, DELAY), _place(spark))
    columns = ["status", "last_error", "last_update", "error_count", "start_time"]
    last = states.groupBy("source").agg(F.max_by(F.struct(*columns), F.struct("last_update", "seq")).alias("now"))
    return last.select("source", "now.*")


@query("r6_stream_rules_reload", """
SELECT sha256(concat_ws('|', rule_name, epoch_us(fired_at)::VARCHAR, line_id::VARCHAR)) AS id, rule_name, source, count, fired_at
FROM fired""", *ALERT_VIEWS, recursive=True)
def r6_stream_rules_reload(spark, sf_dir):
    place, lines = _place(spark), log_lines(_StreamingReads(spark), sf_dir)
    alerts = ReloadingAlerts(rules_table, lambda events: events.write.mode("append").parquet(f"{place}/out"), f"{place}/rules")
    writer = lines.writeStream.foreachBatch(alerts).option("checkpointLocation", f"{place}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").select("id", "rule_name", "source", "count", "fired_at")


@query("r7_stream_metrics", """
SELECT time_bucket(INTERVAL 15 SECOND, ts) AS start, source, level, count(*) AS total FROM log_lines GROUP BY ALL""", LOG_LINES_SQL)
def r7_stream_metrics(spark, sf_dir):
    lines = log_lines(_StreamingReads(spark), sf_dir)
    return run_to_end(lines, lambda s: stream_metrics_by_interval(s, delay=DELAY), _place(spark))


@query("r9_stream_sinks", "SELECT source, level, count(*) AS total FROM log_lines GROUP BY ALL", LOG_LINES_SQL)
def r9_stream_sinks(spark, sf_dir):
    place, lines = _place(spark), log_lines(_StreamingReads(spark), sf_dir)
    sinks = [lambda batch, name=name: batch.write.mode("append").parquet(f"{place}/{name}") for name in ("one", "two")]
    running = stream_sinks(lines, sinks, f"{place}/state", interval="1 second")
    running.processAllAvailable()
    running.stop()
    both = spark.read.parquet(f"{place}/one").intersectAll(spark.read.parquet(f"{place}/two"))
    return logs_total(both)
