from datetime import datetime

from pyspark.sql import functions as F

from sawlog.operators.parse import parse_logs

# raw, format, level, message, fields as JSON, error
CASES = [
    ('{"ts":"2023-07-04T01:02:03Z","severity":"CRIT","log":"disk sda is full"}', "json", "fatal", "disk sda is full", "{}", None),
    ('{"loglevel":"notice","text":"cache warmed","hits":7}', "json", "info", "cache warmed", '{"hits":7}', None),
    ('kernel: {"lvl":"WARNING","msg":"clock drift","ms":-3}', "json", "warn", "clock drift", '{"ms":-3}', None),
    ("   ", "json", "info", "   ", "{}", "empty"),
    ("no braces here", "json", "info", "no braces here", "{}", "invalid_format"),
    ('{"msg": "cut off', "json", "info", '{"msg": "cut off', "{}", "invalid_format"),
    ("[1, 2, 3]", "json", "info", "[1, 2, 3]", "{}", "invalid_format"),
    ('{"n":1,"n":2,"text":{"q":1,"p":"<&>"}} and more', "json", "info", '{"p":"\\u003c\\u0026\\u003e","q":1}', '{"n":2}', None),
    ('{"time":"soon","datetime":1688432523.25,"level":null,"log":98765432}', "json", "info", "9.8765432e+07", '{"time":"soon"}', None),
    ('{"log":"42"}', "json", "info", "42", "{}", None),
    ('{"text":null}', "json", "info", "null", "{}", None),
    ("{" + ",".join(f'"f{i}":{i}' for i in range(100)) + "}", "json", "info", "", None, None),
    ("{" + ",".join(f'"f{i}":{i}' for i in range(101)) + "}", "json", "info", None, "{}", "too_many_fields"),
    ('ts=2023-07-04T01:02:03Z lvl=err text="pump stopped"', "logfmt", "error", "pump stopped", "{}", None),
    ('severity=debug log="two words" took=9ms path="/a b"', "logfmt", "debug", "two words", '{"took":"9ms","path":"/a b"}', None),
    ('n=1 n=2 n=3 lvl=fatal log=""', "logfmt", "fatal", "", '{"n":"3"}', None),
    ('log="never closed lvl=warn', "logfmt", "warn", '"never', "{}", None),
    ("[2023-07-04 01:02:03] WARN: low battery", "text", "warn", "low battery", "{}", None),
    ("2023-07-04T01:02:03Z FATAL power lost", "text", "fatal", "power lost", "{}", None),
    ("DEBUG: tick", "text", "debug", "tick", "{}", None),
    ("[2023-07-04 01:02:03] verbose: tock", "text", "info", "tock", "{}", None),
    ("nothing special in this line", "text", "info", "nothing special in this line", "{}", None),
    ('2023-07-04T01:02:03Z fan.rpm: {"severity":"err","log":"too slow"}', "auto", "error", "too slow", "{}", None),
    ("lvl=warning log=hot zone=3", "auto", "warn", "hot", '{"zone":"3"}', None),
    ("[2023-07-04 01:02:03] ERROR: door open", "auto", "error", "door open", "{}", None),
    ("empty {} object", "auto", "info", "", "{}", None),
    ("y" * (256 * 1024 + 1), "auto", "info", None, "{}", "too_large"),
]


def test_formats(spark):
    rows = [(i, c[0], c[1]) for i, c in enumerate(CASES)]
    lines = spark.createDataFrame(rows, "line_id long, raw string, fmt string")
    parsed = parse_logs(lines, F.col("fmt")).withColumn("fields", F.to_json("fields"))
    got = {r.line_id: r for r in parsed.collect()}
    for i, (_, _, level, message, fields, error) in enumerate(CASES):
        row = got[i]
        assert (row.level, row.parse_error) == (level, error), CASES[i][0][:80]
        if message is not None:
            assert row.message == message
        if fields is not None:
            assert row.fields == fields


def test_strict_detection_and_envelope(spark):
    lines = spark.createDataFrame(
        [(0, "user a=1 b=2", datetime(2024, 1, 1), "warn"), (1, '{"level":"error"}', None, "warn")],
        "line_id long, raw string, env_ts timestamp, env_level string",
    )
    rows = {r.line_id: r for r in parse_logs(lines, auto="strict").collect()}
    assert (rows[0].format, rows[0].message, rows[0].level) == ("text", "user a=1 b=2", "warn")
    assert rows[0].ts == datetime(2024, 1, 1) and rows[0].ts_source == "envelope"
    assert rows[1].level == "error"
    plain = {r.line_id: r for r in parse_logs(lines, keep_envelope=False).collect()}
    assert plain[0].message == "" and plain[0].ts is None


def test_filter_after_parse_plans_quickly(spark):
    lines = spark.range(100).selectExpr("id AS line_id", "concat('level=warn msg=m', id) AS raw")
    assert parse_logs(lines).where("level = 'warn' AND message LIKE 'm1%'").count() == 11


def test_limits_can_be_off(spark):
    wide = "{" + ",".join(f'"f{i}":{i}' for i in range(150)) + ',"log":"x"}'
    lines = spark.createDataFrame([(0, wide), (1, "z" * 300_000)], "line_id long, raw string")
    rows = {r.line_id: r for r in parse_logs(lines, max_line_bytes=None, max_fields=None).collect()}
    assert rows[0].message == "x" and len(rows[0].fields) == 150
    assert rows[1].parse_error is None and len(rows[1].message) == 300_000


def test_many_pairs_take_linear_time(spark):
    import time

    few = [(i, f"k{i}=1 lvl=warn") for i in range(4)]
    lines = lambda raw: spark.createDataFrame([*few, (9, raw)], "line_id long, raw string")
    took = []
    parse_logs(lines("a=1 b=2"), "logfmt").collect()
    for raw in ("a=1 b=2", "k=value " * 30_000, " ".join(f"k{i}=v" for i in range(30_000))):
        frame = parse_logs(lines(raw), "logfmt")
        start = time.perf_counter()
        rows = {r.line_id: r for r in frame.collect()}
        took.append(time.perf_counter() - start)
    assert rows[9].parse_error == "too_many_fields"
    assert max(took[1:]) < took[0] + 2
