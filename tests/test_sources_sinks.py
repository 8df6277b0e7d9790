import gzip
import json
import os
import re
from collections import Counter
from datetime import date, datetime, timezone

import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sawlog.functions.regexes import RegexError, translate_regex
from sawlog.operators.history import purge_stored
from sawlog.plans import queries_files
from sawlog.plans.views import log_lines
from sawlog.session import plain_checkpoints
from sawlog.sinks import files
from sawlog.sinks.alerts import known_events, append_alert_events, write_alerts
from sawlog.sinks.delivery import DeliveryError, check_response, deliver, retry_wait, write_bulk, write_webhook
from sawlog.sinks.files import text_lines, write_all, write_ndjson, write_rotated, write_text
from sawlog.sources.files import log_inventory, read_log_files
from sawlog.sources.tail import FORMAT, TailStreamReader, register, log_tail, read_from_bookmark


@pytest.fixture
def lines(spark):
    rows = [(i, datetime(2024, 1, 15 + i % 2, 10, 30, 0, 500000), "error" if i % 2 else "info", f"m{i} <a>", "app.log")
            for i in range(25)]
    return spark.createDataFrame(rows, "line_id long, ts timestamp, level string, message string, source string")


def test_read_log_files(spark, tmp_path):
    big = "é" * (128 * 1024) + "x"
    (tmp_path / "a.log").write_bytes(b"one\r\n\n\rtwo\rmid\n" + big.encode() + b"\nlast\xe2\x80\xa8end")
    rows = read_log_files(spark, str(tmp_path / "a.log")).collect()
    assert [r.raw for r in rows] == ["one", "\rtwo\rmid", "é" * (128 * 1024), "last end"]
    assert [r.truncated for r in rows] == [False, False, True, False]
    assert rows[0].source == str(tmp_path / "a.log")


def test_inventory(spark, tmp_path):
    (tmp_path / "nginx").mkdir()
    for name, text in (("nginx/access.log", "x"), ("nginx/empty.log", ""), ("nginx/notes.txt", "x")):
        (tmp_path / name).write_text(text)
    rows = log_inventory(spark, [str(tmp_path)]).collect()
    assert [(r.name, r.length, r.too_large) for r in rows] == [("nginx-access", 1, False)]
    with open(tmp_path / "huge.log", "wb") as file:
        file.truncate((1 << 30) + 1)
    flags = lambda **limit: {r.name.split("/")[-1]: r.too_large for r in log_inventory(spark, [str(tmp_path)], **limit).collect()}
    assert sorted(flags().values()) == [False, True] and not any(flags(max_bytes=None).values())


def test_bookmark_and_rotation(spark, tmp_path):
    log = tmp_path / "t.log"
    log.write_text("one\ntwo\npart")
    inode = os.stat(log).st_ino
    raw = lambda mark=None: [r.raw for r in read_from_bookmark(spark, str(log), mark).collect()]
    assert raw() == ["one", "two", "part"]
    assert raw({str(log): [4, inode]}) == ["two", "part"]
    assert raw({str(log): [4, inode + 1]}) == ["one", "two", "part"]
    assert raw({str(log): [400, inode]}) == ["one", "two", "part"]


def test_tail_stream_appends_and_rotation(spark, tmp_path):
    log, out, state = tmp_path / "s.log", str(tmp_path / "out"), str(tmp_path / "state")
    log.write_text("one\ntw")

    def run():
        query = log_tail(spark, str(log)).select("raw").writeStream.format("text")
        query = query.option("checkpointLocation", state).trigger(once=True).start(out)
        query.awaitTermination()
        return sorted(r.value for r in spark.read.text(out).collect())

    assert run() == ["one"]
    with open(log, "a") as file:
        file.write("o\nthree\n")
    assert run() == ["one", "three", "two"]
    # Written before a rotation, and not read yet; the old file goes on under another name.
    with open(log, "a") as file:
        file.write("last\nopen end")
    os.rename(log, tmp_path / "s.log.1")
    log.write_text("four\n")
    assert run() == ["four", "last", "one", "open end", "three", "two"]
    with open(log, "a") as file:
        file.write("five\n")
    assert run() == ["five", "four", "last", "one", "open end", "three", "two"]
    (tmp_path / "new").write_text("six\n")
    os.replace(tmp_path / "new", log)
    assert run()[-2:] == ["three", "two"] and "six" in run()


def test_log_tail_query_follows_folders_side_by_side(spark, tmp_path, monkeypatch):
    rows = spark.range(3_000).selectExpr("id AS event_id", "id % 7 AS user_id", "IF(id % 5 = 0, 'error', 'view') AS event_type",
                                         "timestamp_seconds(1700000000 + id DIV 100) AS ts")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    followed = []

    def tail(spark, path, **options):
        followed.append((path, options, len(spark.streams.active)))
        return log_tail(spark, path, **options)

    monkeypatch.setattr(queries_files, "log_tail", tail)
    monkeypatch.setattr(queries_files, "LINES_PER_STREAM", 1_000, raising=False)
    before = len(spark.streams.active)
    got = {r.raw: r.n for r in queries_files.s2_log_tail(spark, str(tmp_path)).collect()}
    want = Counter(r.value for r in text_lines(log_lines(spark, str(tmp_path))).collect())
    assert got == want and sum(got.values()) == 3_000
    many = min(3, spark.sparkContext.defaultParallelism)
    assert len({path for path, _, _ in followed}) == len(followed) == many
    assert [active - before for _, _, active in followed] == list(range(many))
    assert all(options == {"max_bytes": 200_000} for _, options, _ in followed)
    assert len(spark.streams.active) == before
    rows.limit(0).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert queries_files.s2_log_tail(spark, str(tmp_path / "none")).collect() == []


def _flaky(mark, often):
    """``log_tail`` in small batches, with a step that fails ``often`` times at one of the lines."""

    def met(text):
        if "22:40:00" in text and (os.path.getsize(mark) if os.path.exists(mark) else 0) < often:
            with open(mark, "a") as file:
                file.write("x")
            raise OSError("no more processes")
        return text

    return lambda spark, path, **options: log_tail(spark, path, max_bytes=5_000).withColumn("raw", F.udf(met)("raw"))


@pytest.mark.parametrize("often", [1, 100])
def test_log_tail_query_goes_on_after_a_failed_batch(spark, tmp_path, monkeypatch, often):
    rows = spark.range(2_000).selectExpr("id AS event_id", "id % 7 AS user_id", "IF(id % 5 = 0, 'error', 'view') AS event_type",
                                         "timestamp_seconds(1700000000 + id) AS ts")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    mark = str(tmp_path / "mark")
    monkeypatch.setattr(queries_files, "log_tail", _flaky(mark, often))
    monkeypatch.setattr(queries_files, "LINES_PER_STREAM", 1_000)
    before = len(spark.streams.active)
    if often == 1:
        got = {r.raw: r.n for r in queries_files.s2_log_tail(spark, str(tmp_path)).collect()}
        assert got == Counter(r.value for r in text_lines(log_lines(spark, str(tmp_path))).collect())
    else:
        with pytest.raises(StreamingQueryException, match="no more processes"):
            queries_files.s2_log_tail(spark, str(tmp_path))
    assert os.path.getsize(mark) == (1 if often == 1 else 3) and len(spark.streams.active) == before


def test_checkpoints_on_mounted_folders_start_no_processes(spark, tmp_path):
    key = "spark.sql.streaming.checkpointFileManagerClass"
    assert spark.conf.get(key, None) is None
    with pytest.raises(ZeroDivisionError), plain_checkpoints(spark, f"file://{tmp_path}"):
        assert spark.conf.get(key).endswith(".FileSystemBasedCheckpointFileManager")
        raise ZeroDivisionError
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "chosen")
    try:
        with plain_checkpoints(spark, str(tmp_path)):
            assert spark.conf.get(key) == "chosen"
        assert spark.conf.get(key) == "chosen"
    finally:
        spark.conf.unset(key)


def test_planned_bytes_are_never_dropped(tmp_path):
    log = tmp_path / "p.log"
    log.write_text("one\ntwo\n")
    reader = TailStreamReader({"path": str(log)})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    os.rename(log, tmp_path / "p.log.1")
    log.write_text("other\n")
    assert [row[3] for part in parts for row in reader.read(part)] == ["one", "two"]
    os.remove(tmp_path / "p.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))


def test_line_limit_can_be_off(spark, tmp_path):
    (tmp_path / "long.log").write_text("a" * 300_000 + "\n")
    read = lambda **o: spark.read.format(FORMAT).options(path=str(tmp_path / "long.log"), **o).load().first()
    register(spark)
    assert (len(read().raw), read().truncated) == (256 * 1024, True)
    assert (len(read(maxLineBytes=0).raw), read(maxLineBytes=0).truncated) == (300_000, False)
    assert len(read_log_files(spark, str(tmp_path / "long.log"), max_line_bytes=None).first().raw) == 300_000


def test_text_files(spark, lines, tmp_path):
    write_all(lines, [lambda d: write_text(d, str(tmp_path / "t")), lambda d: write_ndjson(d, str(tmp_path / "j"))])
    text = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert "[2024-01-15 10:30:00] [app.log] INFO: m0 <a>" in text and len(text) == 25
    first = min(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert first == ('{"timestamp":"2024-01-15T10:30:00.5Z","level":"info","message":"m0 \\u003ca\\u003e","source":"app.log"}')


def test_write_all_stops_at_first_failure(lines):
    seen = []

    def broken(_):
        raise OSError("full")

    with pytest.raises(OSError):
        write_all(lines, [lambda d: seen.append(1), broken, lambda d: seen.append(2)])
    assert seen == [1]


def test_rotation_by_size_and_age(lines, tmp_path):
    path = str(tmp_path / "rot")
    write_rotated(lines.coalesce(1), path, max_bytes=200, compress=True, max_age="24h", now=datetime(2024, 1, 17, tzinfo=timezone.utc))
    days = sorted(d for d in os.listdir(path) if d.startswith("day="))
    assert days == ["day=2024-01-16"]
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{path}/{days[0]}") for f in names if f.endswith(".gz")]
    assert len(files) > 1
    assert all(len(gzip.open(f).read()) <= 200 for f in files)


def test_rotation_with_uneven_lines(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), "info", "x" * (1 if i % 10 else 150), "s") for i in range(300)]
    frame = spark.createDataFrame(rows, "line_id long, ts timestamp, level string, message string, source string")
    write_rotated(frame, str(tmp_path / "r"), max_bytes=400)
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "r") for f in names if f.startswith("part-")]
    assert max(sizes) <= 400 and spark.read.text(str(tmp_path / "r")).count() == 300


def test_small_rotated_files_share_the_folder_of_their_day(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 3), "info", f"m{i} " + "é" * (i % 40), "s") for i in range(3_000)]
    frame = spark.createDataFrame(rows, "line_id long, ts timestamp, level string, message string, source string")
    write_rotated(frame.coalesce(2), str(tmp_path / "r"), max_bytes=400)
    found = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "r") for f in names if f.startswith("part-")]
    assert {os.path.relpath(os.path.dirname(f), tmp_path / "r") for f in found} == {f"day=2024-01-0{day}" for day in (1, 2, 3)}
    # No file is over the limit, and none is closed while the next line of its task and day fits.
    assert max(map(os.path.getsize, found)) <= 400 and sum(os.path.getsize(f) < 270 for f in found) <= 6
    back = sorted((str(r.day), r.value) for r in spark.read.text(str(tmp_path / "r")).collect())
    assert back == sorted((f"2024-01-0{1 + i % 3}", f"[2024-01-0{1 + i % 3} 00:00:00] [s] INFO: {row[3]}") for i, row in enumerate(rows))


def test_open_rotated_files_are_bounded(monkeypatch):
    monkeypatch.setattr(files, "HELD_BYTES", 1_000)
    days = pa.array([date(2024, 1, 1 + i % 25) for i in range(100)], pa.date32())
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:099d}" for i in range(100)]), days, pa.array([100] * 100)], ["value", "day", "size"])
    out = list(files._whole(100_000)(iter([batch.slice(at, 10) for at in range(0, 100, 10)])))
    lines = [line for part in out for value in part.column("value").to_pylist() for line in value.split("\n")]
    assert sorted(lines) == sorted(batch.column("value").to_pylist())
    assert max(sum(map(len, part.column("value").to_pylist())) for part in out) <= 2_000


def test_bulk_and_webhook_delivery(spark, lines, tmp_path):
    write_bulk(lines, "logs-%{+YYYY}", {"path": str(tmp_path / "bulk")}, size=10)
    write_bulk(lines, "logs-%{+YYYY}", {"path": str(tmp_path / "bulk")}, size=10)
    bodies = [open(tmp_path / "bulk" / f).read() for f in os.listdir(tmp_path / "bulk")]
    assert sorted(len(b.splitlines()) for b in bodies) == [10, 20, 20]
    action = json.loads(bodies[0].splitlines()[0])["index"]
    assert action["_index"] == "logs-2024" and len(action["_id"]) == 64
    write_webhook(lines, {"path": str(tmp_path / "hook")}, F.lit(datetime(2024, 2, 1)), "warn", 5)
    payloads = [json.load(open(tmp_path / "hook" / f)) for f in os.listdir(tmp_path / "hook")]
    assert sorted(p["count"] for p in payloads) == [2, 5, 5] and all("ERROR" in p["text"] for p in payloads)


def test_delivery_retries():
    waits, tries = [], []

    def flaky(body_id, body, attempt):
        tries.append(attempt)
        if attempt < 2:
            raise DeliveryError("no")

    deliver(flaky, "id", "body", 3, sleep=waits.append)
    assert tries == [0, 1, 2] and waits == [0.0, 0.5, 1.0] and retry_wait(20) == 30.0
    with pytest.raises(DeliveryError):
        deliver(flaky, "id", "body", 2, sleep=waits.append)
    for status, answer in ((500, b""), (200, b"not json"), (200, b'{"errors":tr'), (200, b'{"errors":false} {}')):
        with pytest.raises(DeliveryError):
            check_response(status, [answer])
    assert check_response(200, [b'{"errors":true}']).errors and not check_response(200, []).errors
    with pytest.raises(DeliveryError, match="no failed document"):
        deliver(lambda *_: check_response(200, [b'{"errors":true}']), "id", "body", 1, sleep=waits.append)


def test_alert_sinks(spark, tmp_path):
    rows = [("e1", "r", "critical", "boom", "app", 0, datetime(2024, 1, 1), None), ("e2", "r", "warning", "b", "", 3, datetime(2024, 1, 2), None)]
    schema = "id string, rule_name string, severity string, message string, source string, count long, fired_at timestamp, acknowledged_at timestamp"
    events = spark.createDataFrame(rows, schema)
    append_alert_events(events, str(tmp_path / "hist"))
    append_alert_events(events, str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "hist")).count() == 2
    plan = known_events(spark, str(tmp_path / "hist"), events.limit(1).withColumn("fired_on", F.to_date("fired_at")))
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan._jdf.queryExecution().executedPlan().toString())[1]
    assert "2024-01-01" in filters or "19723" in filters
    assert purge_stored(spark, str(tmp_path / "hist"), datetime(2024, 1, 2, 1), "2h") == 1
    assert [r.id for r in spark.read.parquet(str(tmp_path / "hist")).collect()] == ["e2"]
    assert purge_stored(spark, str(tmp_path / "hist"), datetime(2024, 1, 2, 12), "1h") == 1
    assert spark.read.schema(schema).parquet(str(tmp_path / "hist")).count() == 0
    write_alerts(events, [{"kind": "webhook", "path": str(tmp_path / "w")}, {"kind": "email", "path": str(tmp_path / "e")}])
    hook = json.load(open(tmp_path / "w" / "webhook-e2"))
    assert hook == {"rule": "r", "severity": "warning", "message": "b", "timestamp": "2024-01-02T00:00:00Z", "count": 3}
    assert "Subject: [Sawlog][CRITICAL] r" in open(tmp_path / "e" / "email-e1").read()


def test_regex_dialect(spark):
    cases = [(r"a$", "a\n", False), (r"[[:alpha:]]+", "123", False), (r"(?P<x>ab)c", "abc", True), (r"\s", "\x0b", False),
             (r"a.b", "a\rb", True), (r"x{", "x{", True), (r"[]a]", "]", True), (r"\bé", "é", False), (r"(?m)a$", "a\nb", True)]
    for pattern, text, want in cases:
        got = spark.range(1).select(F.lit(text).rlike(translate_regex(pattern))).first()[0]
        assert got == want, pattern
    for bad in (r"(?=a)", r"(a)\1", "a**", "a++", "[a", "(a", r"\Z", "a{1001}"):
        with pytest.raises(RegexError):
            translate_regex(bad)
