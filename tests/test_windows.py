import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sawlog.operators import anchored
from sawlog.operators.alerts import apply_cooldown, error_rate_alerts, evaluate_alerts
from sawlog.operators.anchored import anchored_windows
from sawlog.operators.collapse import collapse_repeats
from sawlog.operators.matching import RuleError, match_rules
from sawlog.schema import RULE_SCHEMA

T0 = datetime(2024, 1, 1)
S = 1_000_000


def scan(points, width):
    """Plain scan: anchor, rows, last."""
    out = []
    for p, n in points:
        if not out or p > out[-1][0] + width:
            out.append([p, n, p])
        else:
            out[-1][1] += n
            out[-1][2] = p
    return [tuple(w) for w in out]


def by_parts(points, width, widths, chunk, monkeypatch):
    """The three passes over Arrow batches, without Spark."""
    monkeypatch.setattr(anchored, "_CHUNK_ROWS", chunk)
    span = (width + 1) * widths
    rows = sorted((k, p - p % span, p, width, n, p) for k, ps in points.items() for p, n in ps)
    names = ["k", "blk", "p", "w", "n", "tag"]
    schema = pa.schema([("k", pa.string())] + [(c, pa.int64()) for c in names[1:]])
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(names)}, schema=schema)
    batches = lambda t: iter(t.to_batches(max_chunksize=chunk))
    entries = table.append_column("hi", table["p"])
    run = anchored._streaming(["k", "blk"], anchored._block_outcomes)
    outcomes = pa.Table.from_batches(run(batches(entries)), schema=entries.schema)
    outcomes = outcomes.sort_by([("k", "ascending"), ("blk", "ascending"), ("hi", "ascending")])
    marked = table.append_column("last", table["p"])
    carried = list(anchored._carry(["k"])(batches(outcomes)))
    if carried:
        marked = pa.concat_tables([marked, pa.Table.from_batches(carried)])
    marked = marked.sort_by([("k", "ascending"), ("blk", "ascending"), ("p", "ascending")])
    found = {}
    for row in pa.Table.from_batches(
        anchored._streaming(["k", "blk"], anchored._block_windows)(batches(marked)), schema=marked.schema
    ).to_pylist():
        cell = found.setdefault((row["k"], row["p"]), [0, row["last"]])
        cell[0] += row["n"]
        cell[1] = max(cell[1], row["last"])
    return sorted((k, p, n, last) for (k, p), (n, last) in found.items())


def test_blocks_equal_plain_scan(monkeypatch):
    rnd = random.Random(7)
    for _ in range(400):
        width, widths = rnd.choice([0, 1, 2, 7, 20, 100]), rnd.choice([1, 2, 3, 8])
        points = {}
        for key in "abc"[: rnd.randint(1, 3)]:
            span = rnd.choice([10, 50, 400, 2000])
            places = sorted({rnd.randrange(-50, span) for _ in range(rnd.choice([1, 5, 40, 200]))})
            points[key] = [(p, rnd.randint(1, 4)) for p in places]
        want = sorted((k, *w) for k, ps in points.items() for w in scan(ps, width))
        assert by_parts(points, width, widths, rnd.choice([1, 2, 3, 7, 50, 1000]), monkeypatch) == want


@pytest.mark.parametrize("widths", [2, 64])
def test_windows_on_spark(spark, widths):
    rnd = random.Random(widths)
    rows, want = [], []
    for key in range(12):
        width, span = rnd.choice([0, 3, 100, 5000]), rnd.choice([10, 400, 100_000])
        places = sorted({rnd.randrange(span) for _ in range(rnd.choice([1, 40, 2000]))})
        points = [(p, rnd.randint(1, 4)) for p in places]
        rows += [(str(key), p, width, n, p) for p, n in points]
        want += [(str(key), *w, w[0]) for w in scan(points, width)]
    frame = spark.createDataFrame(rows, "k string, p long, w long, n long, tag long")
    got = anchored_windows(frame, ["k"], widths).select("k", "p", "n", "last", "tag").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def _lines(spark, rows):
    """rows: (source, level, message, seconds)"""
    data = [(i, T0 + timedelta(seconds=t), lv, m, s) for i, (s, lv, m, t) in enumerate(rows)]
    return spark.createDataFrame(data, "line_id long, ts timestamp, level string, message string, source string")


def test_collapse_cases(spark):
    rows = [("app", "error", "timeout", t) for t in (0, 3, 10, 10.5)] + [("app", "info", "hello", 0)] + [
        ("app2", "error", "timeout", 0), ("app", "warn", "timeout", 0)]
    out = collapse_repeats(_lines(spark, rows), "10s").collect()
    got = sorted((r.source, r.level, r.message, r["count"]) for r in out)
    assert got == [
        ("app", "error", "timeout", 1), ("app", "error", "timeout (x3 in last 10s)", 3), ("app", "info", "hello", 1),
        ("app", "warn", "timeout", 1), ("app2", "error", "timeout", 1),
    ]
    assert sorted(r["count"] for r in collapse_repeats(_lines(spark, rows), "10s", min_count=4).collect()) == [1, 1, 1, 1, 3]


def test_collapse_ties_and_hot_key(spark):
    rows = [("app", "error", "same", t // 50) for t in range(2000)]
    out = collapse_repeats(_lines(spark, rows), "3s").collect()
    assert len(out) == 10 and all(r["count"] == 200 for r in out)
    assert min(r.line_id for r in out) == 0


def _rules(spark, *rules):
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _rate_model(times, need, window):
    held, fires = [], []
    for i, t in enumerate(times):
        held = [h for h in held if h >= t - window] + [t]
        if len(held) >= need:
            fires.append(i)
            held = []
    return fires


@pytest.mark.parametrize("need,window", [(1, 5), (3, 4), (5, 30)])
def test_error_rate_equals_model(spark, need, window):
    rnd = random.Random(need)
    times = sorted(rnd.randrange(300) for _ in range(300))
    lines = _lines(spark, [("s", "error", "e", t) for t in times] + [("s", "info", "i", 5)] * 4)
    rules = _rules(spark, ("r", "error_rate", "critical", None, None, None, need, window * S, 0))
    fired = error_rate_alerts(lines, rules)
    assert sorted(r.line_id for r in fired.collect()) == _rate_model(times, need, window)
    assert {r["count"] for r in fired.collect()} == {need}


def test_cooldown_edges(spark):
    times = [0, 0, 99, 100, 150, 200]
    rows = [("a", T0 + timedelta(milliseconds=t), i, 100_000) for i, t in enumerate(times)]
    rows += [("b", T0, 10, 0), ("b", T0, 11, 0)]
    events = spark.createDataFrame(rows, "rule_name string, fired_at timestamp, line_id long, cooldown_us long")
    assert sorted(r.line_id for r in apply_cooldown(events).collect()) == [0, 3, 5, 10, 11]


def test_alert_cases(spark):
    lines = _lines(spark, [
        ("app-logs", "error", "java.lang.OutOfMemoryError: heap space", 0), ("other", "info", "started", 1),
        ("other", "fatal", "crash", 2), ("app-logs", "notice", "crash", 3),
    ])
    rules = _rules(
        spark, ("oom", "pattern", "critical", "OutOfMemory|OOM", None, None, None, None, 0),
        ("fatal", "level", "warning", None, "FATAL", None, None, None, 0),
        ("mine", "pattern", "warning", "crash", None, "app-logs", None, None, 0),
        ("h", "health_change", "warning", None, None, None, None, None, 0),
    )
    got = sorted((r.rule_name, r.source, r.message) for r in evaluate_alerts(lines, rules).collect())
    assert got == [
        ("fatal", "other", "[FATAL] crash"), ("mine", "app-logs", "Pattern matched: crash"),
        ("oom", "app-logs", "Pattern matched: java.lang.OutOfMemoryError: heap space"),
    ]


@pytest.mark.parametrize("rule", [
    ("x", "pattern", "w", "(", None, None, None, None, 0), ("x", "level", "w", None, "loud", None, None, None, 0),
    ("x", "odd", "w", None, None, None, None, None, 0), ("x", "pattern", "w", "(?=a)", None, None, None, None, 0),
])
def test_bad_rule_rejects_the_set(spark, rule):
    with pytest.raises(ValueError):
        match_rules(_lines(spark, [("s", "info", "m", 0)]), _rules(spark, rule))
    assert issubclass(RuleError, ValueError) and F


def test_long_chains_take_few_rounds(monkeypatch):
    """A block of many windows is not walked window by window: places are looked up once a chunk."""
    rounds, past = [], anchored._past
    monkeypatch.setattr(anchored, "_past", lambda *a: rounds.append(1) or past(*a))
    points = {"a": [(i, 1) for i in range(6_000)], "b": [(3 * i + i % 2, 2) for i in range(2_000)]}
    found = by_parts(points, 2, 2_000, 4_000, monkeypatch)
    assert found == sorted((k, *w) for k, ps in points.items() for w in scan(ps, 2))
    assert len(rounds) < 20
