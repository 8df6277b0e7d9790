"""Round trips of the test tables through files: sources and sinks."""

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.functions.times import micros
from sawlog.operators.metrics import logs_total
from sawlog.plans.catalog import query
from sawlog.plans.queries_lines import DOC_SQL
from sawlog.plans.views import ALERT_HISTORY_SQL, LOG_LINES_SQL, alert_history, log_lines
from sawlog.session import checkpoint_dir, plain_checkpoints
from sawlog.sinks.alerts import append_alert_events, read_alert_events, write_alerts
from sawlog.sinks.delivery import read_spool
from sawlog.sinks.files import text_lines, write_all, write_ndjson, write_rotated, write_text
from sawlog.sources.files import log_inventory, read_log_files
from sawlog.sources.tail import log_tail, read_from_bookmark
from sawlog.streaming.flush import run_until_still
from sawlog.streaming.reload import LateRows

STREAMS = 8  # of the tail source that run at a time
LINES_PER_STREAM = 50_000  # at least

TEXT_SQL = """'[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || source || '] ' || upper(level) || ': ' || message"""


def _place(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/sawlog-files/{uuid.uuid4().hex}"


def _local(path: str) -> str:
    """The path for readers that open files themselves; the folder must be mounted everywhere."""
    return path.removeprefix("file://")


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    place = _place(spark)
    write_text(log_lines(spark, sf_dir), place)
    return place


def _log_folders(spark: SparkSession, sf_dir: str) -> list[str]:
    """The lines dealt evenly into folders of log files, the more the more lines there are, up to one for each core and ``STREAMS``."""
    lines, place = log_lines(spark, sf_dir), _place(spark)
    streams = max(1, min(STREAMS, spark.sparkContext.defaultParallelism, lines.count() // LINES_PER_STREAM))
    dealt = text_lines(lines).withColumn("folder", F.monotonically_increasing_id() % streams)
    dealt.write.partitionBy("folder").text(place)
    return [f"{place}/folder={no}" for no in range(streams)]


@query("s1_read_log_files", f"SELECT {TEXT_SQL} AS raw, false AS truncated, count(*) AS n FROM log_lines GROUP BY ALL", LOG_LINES_SQL)
def s1_read_log_files(spark, sf_dir):
    lines = read_log_files(spark, f"{_log_files(spark, sf_dir)}/*.txt", "app")
    return lines.groupBy("raw", "truncated").agg(F.count("*").alias("n"))


@query("s2_log_tail", f"SELECT {TEXT_SQL} AS raw, count(*) AS n FROM log_lines GROUP BY ALL", LOG_LINES_SQL)
def s2_log_tail(spark, sf_dir):
    folders, out = _log_folders(spark, sf_dir), _place(spark)

    def start(no: int):
        stream = log_tail(spark, f"{_local(folders[no])}/*.txt", max_bytes=200_000).select("raw")
        return stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state-{no}").start(f"{out}/out-{no}")

    with plain_checkpoints(spark, out):
        run_until_still([functools.partial(start, no) for no in range(len(folders))])
    # Each folder by itself, so that the log of its stream tells which files count.
    read = [spark.read.schema("raw string").parquet(f"{out}/out-{no}") for no in range(len(folders))]
    return functools.reduce(DataFrame.unionByName, read).groupBy("raw").agg(F.count("*").alias("n"))


@query("s3_read_from_bookmark", f"SELECT {TEXT_SQL} AS raw, count(*) AS n FROM log_lines GROUP BY ALL", LOG_LINES_SQL)
def s3_read_from_bookmark(spark, sf_dir):
    return read_from_bookmark(spark, f"{_local(_log_files(spark, sf_dir))}/*.txt").groupBy("raw").agg(F.count("*").alias("n"))


@query("s11_log_inventory", """
SELECT source AS name, sum(octet_length(encode(message)) + 1)::BIGINT AS length, false AS too_large FROM log_lines GROUP BY source""", LOG_LINES_SQL)
def s11_log_inventory(spark, sf_dir):
    place = _place(spark)
    log_lines(spark, sf_dir).repartition("source").select("source", "message").write.partitionBy("source").text(place)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(fs_path(place)):  # one file per service
        name = folder.getPath().getName()
        if "=" in name:
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, fs_path(f"{place}/{name.split('=')[1]}.log"))
    found = log_inventory(spark, [place])
    return found.select(F.regexp_extract("path", r"([^/]+)\.log$", 1).alias("name"), "length", "too_large")


@query("k2_write_ndjson", f"SELECT {DOC_SQL} AS value, count(*) AS n FROM log_lines GROUP BY ALL", LOG_LINES_SQL)
def k2_write_ndjson(spark, sf_dir):
    place = _place(spark)
    write_ndjson(log_lines(spark, sf_dir), place)
    return spark.read.text(place).groupBy("value").agg(F.count("*").alias("n"))


@query("k3_write_rotated", f"""
SELECT ts::DATE AS day, {TEXT_SQL} AS value, count(*) AS n, true AS fits FROM log_lines GROUP BY ALL""", LOG_LINES_SQL)
def k3_write_rotated(spark, sf_dir):
    place, limit = _place(spark), 4_000
    write_rotated(log_lines(spark, sf_dir), place, max_bytes=limit)
    back = spark.read.text(place).select("day", "value", F.col("_metadata.file_size").alias("size"))
    return back.groupBy("day", "value").agg(F.count("*").alias("n"), (F.max("size") <= limit).alias("fits"))


@query("k6_write_alerts", """
SELECT 'webhook-' || id AS name, '{"rule":"' || rule_name || '","severity":"' || severity || '","message":"' || message || '","source":"' || source
  || '","timestamp":"' || strftime(fired_at, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(fired_at, '.%f'), '0'), '.') || 'Z"'
  || CASE WHEN count <> 0 THEN ',"count":' || count ELSE '' END || '}' AS body FROM alert_history""", ALERT_HISTORY_SQL)
def k6_write_alerts(spark, sf_dir):
    place = _place(spark)
    write_alerts(alert_history(spark, sf_dir), [{"kind": "webhook", "transport": "spool", "path": _local(place)}])
    return read_spool(spark, place).select(F.col("id").alias("name"), "body")


@query("k7_append_alert_events", "SELECT id, rule_name, severity, fired_at, fired_at::DATE AS fired_on FROM alert_history", ALERT_HISTORY_SQL)
def k7_append_alert_events(spark, sf_dir):
    place, events = _place(spark), alert_history(spark, sf_dir)
    append_alert_events(events.where(F.xxhash64("id") % 3 != 0), place)
    append_alert_events(events, place)
    return read_alert_events(spark, place).select("id", "rule_name", "severity", "fired_at", "fired_on")


@query("k8_write_all", "SELECT source, level, 2 * count(*) AS total FROM log_lines GROUP BY ALL", LOG_LINES_SQL)
def k8_write_all(spark, sf_dir):
    place = _place(spark)
    write_all(log_lines(spark, sf_dir), [lambda d, n=n: d.write.parquet(f"{place}/sink={n}") for n in range(2)])
    return logs_total(spark.read.parquet(place))


@query("r8_late_rows", """
, edges AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle, max(ts) AS last FROM log_lines)
SELECT line_id, ts < middle AND ts <= last - INTERVAL 10 DAY AS late FROM log_lines, edges""", LOG_LINES_SQL)
def r8_late_rows(spark, sf_dir):
    """The later half first: of the earlier half, what lies over ten days before the newest is late."""
    place, lines = _place(spark), log_lines(spark, sf_dir)
    low, high = lines.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    first = micros("ts") < low + (high - low) // 2
    split = LateRows(
        lambda rows: rows.select("line_id", F.lit(False).alias("late")).write.mode("append").parquet(f"{place}/out"),
        lambda rows: rows.select("line_id", F.lit(True).alias("late")).write.mode("append").parquet(f"{place}/out"), f"{place}/state", "240h")
    split(lines.where(~first), 0)
    split(lines.where(first), 1)
    return spark.read.parquet(f"{place}/out")
