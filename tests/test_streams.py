import random
import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest

from sawlog.operators.alerts import evaluate_alerts
from sawlog.operators.collapse import collapse_repeats
from sawlog.plans import queries_streams
from sawlog.schema import RULE_SCHEMA
from sawlog.streaming import streams
from sawlog.streaming.processors import AlertProcessor, CollapseProcessor, HealthProcessor
from sawlog.streaming.reload import LateRows, ReloadingAlerts
from sawlog.streaming.streams import stream_alerts, stream_collapse

T0 = datetime(2024, 1, 1)
SCHEMA = "line_id long, ts timestamp, level string, message string, source string"
S = 1_000_000


def _rows(n, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(4000) for _ in range(n))
    return [(i, T0 + timedelta(seconds=t), rnd.choice(["error", "info"]), rnd.choice("ab"), rnd.choice(["x", "y"]))
            for i, t in enumerate(times)]


def _stream(spark, tmp_path, rows, cuts, build, shuffle_by=3):
    """Feed the rows as files, one per micro-batch, and return what the query wrote."""
    source = tmp_path / uuid.uuid4().hex
    edges = [0, *cuts, len(rows)]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        part = rows[low:high]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = tmp_path / uuid.uuid4().hex
    frame = build(stream)
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
    query.trigger(availableNow=True).start(str(out)).awaitTermination()
    return spark.read.schema(frame.schema).parquet(str(out))


END = [(10_000, T0 + timedelta(days=1), "debug", "end", "z"), (10_001, T0 + timedelta(days=2), "debug", "end", "z")]


@pytest.mark.parametrize("cuts", [[], [50, 120]])
def test_collapse_stream_equals_batch(spark, tmp_path, cuts):
    rows = _rows(200, 3)
    want = collapse_repeats(spark.createDataFrame(rows, SCHEMA), "60s").select("line_id", "message", "count")
    got = _stream(spark, tmp_path, rows + END, [*cuts, 200, 201],
                  lambda s: stream_collapse(s, "60s", delay="5 seconds")).where("source <> 'z'")
    assert sorted(got.select("line_id", "message", "count").collect()) == sorted(want.collect())


def test_alert_stream_equals_batch(spark, tmp_path):
    rules = spark.createDataFrame([
        ("rate", "error_rate", "critical", None, None, None, 3, 120 * S, 300 * S),
        ("lv", "level", "warning", None, "error", "x", None, None, 100 * S),
        ("free", "pattern", "warning", "^a$", None, "y", None, None, 0),
    ], RULE_SCHEMA)
    rows = _rows(200, 5)
    want = evaluate_alerts(spark.createDataFrame(rows, SCHEMA), rules)
    got = _stream(spark, tmp_path, rows + END, [70, 200, 201], lambda s: stream_alerts(s, rules, delay="5 seconds"))
    pick = lambda d: sorted((r.id, r.message, r["count"], r.fired_at) for r in d.collect())
    assert pick(got) == pick(want)


def test_reloading_alerts_keep_their_clock(spark, tmp_path):
    rules = [("rate", "error_rate", "critical", None, None, None, 3, 120 * S, 300 * S),
             ("lv", "level", "warning", None, "error", "x", None, None, 100 * S)]
    rows, seen = _rows(120, 9), []
    alerts = ReloadingAlerts(lambda s: s.createDataFrame(rules, RULE_SCHEMA), lambda d: seen.extend(d.collect()), str(tmp_path / "st"))
    for batch, (low, high) in enumerate([(0, 40), (40, 90), (90, 120)]):
        alerts(spark.createDataFrame(rows[low:high], SCHEMA), batch)
    want = evaluate_alerts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rules, RULE_SCHEMA))
    assert sorted(r.id for r in seen) == sorted(r.id for r in want.collect())


def _reloaded(spark, path, rules_by_batch, batches):
    seen = []
    current = {}
    alerts = ReloadingAlerts(lambda s: s.createDataFrame(current["rules"], RULE_SCHEMA), lambda d: seen.extend(d.collect()), path)
    for no, (rules, secs) in enumerate(zip(rules_by_batch, batches)):
        current["rules"] = rules
        rows = [(100 * no + i, T0 + timedelta(seconds=s), "error", "x", "a") for i, s in enumerate(secs)]
        alerts(spark.createDataFrame(rows, SCHEMA), no)
    return [(int((r.fired_at - T0).total_seconds()), r["count"]) for r in seen]


def test_disorder_between_batches_and_rule_changes(spark, tmp_path):
    import os

    slow = [("lv", "level", "warning", None, "error", None, None, None, 100 * S)]
    quick = [("lv", "level", "critical", None, "error", None, None, None, 20 * S)]
    # 950 comes after 1000 was fired: by arrival it is inside the cooldown. The clock outlives the change of rules.
    got = _reloaded(spark, str(tmp_path / "a"), [slow, slow, quick, quick], [[1000], [950, 1099], [1010, 1025], [1030, 1046]])
    assert got == [(1000, 0), (1025, 0), (1046, 0)]
    assert sorted(os.listdir(tmp_path / "a" / "clock")) == ["batch=2", "batch=3"]
    rate = [("rate", "error_rate", "critical", None, None, None, 3, 60 * S, 0)]
    # The late error counts as of the last one seen.
    assert _reloaded(spark, str(tmp_path / "b"), [rate, rate], [[100, 110], [20, 400]]) == [(20, 3)]


def test_late_rows(spark, tmp_path):
    late, good = [], []
    split = LateRows(lambda d: good.extend(d.collect()), lambda d: late.extend(d.collect()), str(tmp_path), "10s")
    at = lambda *secs: spark.createDataFrame([(i, T0 + timedelta(seconds=s), "info", "m", "s") for i, s in enumerate(secs)], SCHEMA)
    split(at(100), 0)
    split(at(95, 80, 90), 1)
    assert (len(good), len(late)) == (2, 2)


class _State:
    """A state variable in memory; ``appends`` counts what a list was given."""

    def __init__(self):
        self.value, self.appends = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if not isinstance(self.value, list) else iter(self.value)

    def update(self, value):
        self.value = value

    put = update

    def appendValue(self, value):
        self.appends += 1
        self.value = (self.value or []) + [value]

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State())

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _processed(processor, key, batches):
    """What comes of the frames of each micro-batch, each followed by a watermark in microseconds."""
    handle, out = _Handle(), []
    processor.init(handle)
    for frames, mark in batches:
        list(processor.handleInputRows(key, iter(frames), None))
        due = [t for t in handle.timers if t < mark // 1000]
        assert len(handle.timers) <= 1
        for t in due:
            handle.timers.discard(t)
            for frame in processor.handleExpiredTimer(key, _At(mark // 1000), None):
                out += list(frame.itertuples(index=False, name=None))
    return out, handle


def _batched(frame, rnd, parts=3, frames=5):
    """Micro-batches in order of time, their rows shuffled and cut into frames."""
    edges = [0, *sorted(rnd.sample(range(1, len(frame)), parts - 1)), len(frame)]
    batches = []
    for low, high in zip(edges, edges[1:]):
        mixed = frame.iloc[low:high].sample(frac=1, random_state=low)
        mark = int(frame["t"].iloc[high - 1]) - 7_000_000
        batches.append(([mixed.iloc[i::frames].reset_index(drop=True) for i in range(frames)], mark))
    return [*batches, ([], 2**60)]


def _plain_alerts(rows):
    counted, last, out = [], None, []
    for r in rows:
        count = 0
        if r.rate:
            counted = [e for e in counted if e >= r.t - r.window_us] + [r.t]
            if len(counted) < r.need:
                continue
            count, counted = len(counted), []
        if r.cooldown_us > 0:
            if last is not None and r.t - last < r.cooldown_us:
                continue
            last = r.t
        out.append(("rule", r.severity, r.message, r.source, count, r.t, r.line_id))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_alert_processor_equals_a_walk_over_the_rows(seed):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(400) * S for _ in range(600))
    rate, need, window, cooldown = [(True, 3, 9 * S, 0), (True, 4, 5 * S, 30 * S), (False, 1, 0, 11 * S)][seed % 3]
    frame = pd.DataFrame({"rule_name": "rule", "t": times, "line_id": range(600), "source": [rnd.choice("xy") for _ in times], "message": "m",
                          "severity": None, "rate": rate, "need": need, "window_us": window, "cooldown_us": cooldown})
    frame.loc[400:, "need"] = 2  # the rule is changed while rows wait
    frame.loc[400:, "window_us"] = 3 * S
    got, handle = _processed(AlertProcessor(), ("rule",), _batched(frame, rnd))
    assert got == _plain_alerts(frame.sort_values(["t", "line_id"]).itertuples(index=False))
    # One addition to the state for a micro-batch, not one for each row.
    assert handle.states["pending"].appends == 3 and not handle.states["pending"].exists()


def _plain_health(rows, changes):
    known, out = None, []
    for r in rows:
        if r.kind == "register":
            known = ("starting", None, 0, r.t)
        else:
            old, error, errors, start = known or ("", None, 0, r.t)
            if changes and old != r.status:
                out.append(("svc", r.t, r.seq, old, r.status))
            failed = r.error is not None
            known = (r.status, r.error if failed else error, errors + failed, start)
        if not changes:
            out.append(("svc", r.t, r.seq, *known))
    return out


@pytest.mark.parametrize("changes", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_health_processor_equals_a_walk_over_the_rows(seed, changes):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(300) * S for _ in range(200))
    kinds = [rnd.choice(["register"] + ["status"] * 9) for _ in times]
    frame = pd.DataFrame({"source": "svc", "t": times, "seq": range(200), "kind": kinds,
                          "status": pd.Series([rnd.choice(["ok", "bad", None]) for _ in times], dtype=object),
                          "error": pd.Series([rnd.choice(["e1", "e2", None, None]) for _ in times], dtype=object)})
    got, handle = _processed(HealthProcessor(changes), ("svc",), _batched(frame, rnd))
    assert got == _plain_health(frame.itertuples(index=False), changes)
    assert handle.states["pending"].appends == 3


@pytest.mark.parametrize("changes", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_health_of_many_sources_in_one_shard(seed, changes):
    """Sources come and go between micro-batches, a missing one and an empty one among them; state is written once for all."""
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(300) * S for _ in range(900))
    names = [None, "", *(f"s{i}" for i in range(60))]
    frame = pd.DataFrame({"shard": 7, "t": times, "seq": range(900), "source": pd.Series([rnd.choice(names[: 10 + i // 10]) for i in range(900)], dtype=object),
                          "kind": [rnd.choice(["register"] + ["status"] * 5) for _ in times],
                          "status": pd.Series([rnd.choice(["ok", "bad", None]) for _ in times], dtype=object),
                          "error": pd.Series([rnd.choice(["e1", "e2", None, None]) for _ in times], dtype=object)})
    got, handle = _processed(HealthProcessor(changes), (7,), _batched(frame, rnd))
    rows = list(frame.itertuples(index=False))
    want = [(name, *w[1:]) for name in names for w in _plain_health([r for r in rows if r.source == name], changes)]
    plain = lambda found: sorted(str([None if pd.isna(v) else v for v in r]) for r in found)
    assert plain(got) == plain(want)
    assert handle.states["pending"].appends == 3 and not handle.states["pending"].exists()


def test_health_sources_share_shards(spark):
    events = spark.range(3000).selectExpr("concat('svc-', id % 1500) AS source", "timestamp_seconds(id) AS ts", "id AS seq", "'status' AS kind",
                                          "'ok' AS status", "CAST(NULL AS string) AS error")
    found = [(r.shard, r.source) for r in streams._health_rows(events, "1 hour").select("shard", "source").distinct().collect()]
    assert len(found) == 1500 and len({shard for shard, _ in found}) <= streams.HEALTH_SHARDS


@pytest.mark.parametrize("seed", range(3))
def test_collapse_processor_equals_a_walk_over_the_rows(seed):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(500) * S for _ in range(300))
    frame = pd.DataFrame({"t": times, "line_id": range(300)})
    want = []
    for r in frame.itertuples(index=False):
        if want and r.t <= want[-1][2] + 9 * S:
            want[-1] = (want[-1][0], want[-1][1] + 1, want[-1][2], r.t)
        else:
            want.append((r.line_id, 1, r.t, r.t))
    got, handle = _processed(CollapseProcessor(9 * S), ("s", "l", "m"), _batched(frame, rnd))
    assert [g[3:] for g in got] == want and handle.states["pending"].appends == 3


def test_stream_input_is_laid_out_in_order_of_time(spark, tmp_path, monkeypatch):
    """Several files make a micro-batch, so that a batch is not one task's work, and no row is later than one of a file after it."""
    monkeypatch.setattr(queries_streams, "ROWS_PER_BATCH", 100)
    monkeypatch.setattr(queries_streams, "LEAST_ROWS_PER_FILE", 10)
    rnd = random.Random(1)
    rows = [(i, None if i % 50 == 0 else T0 + timedelta(seconds=rnd.randrange(10_000))) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    stream = queries_streams._StreamingReads(spark).parquet(str(tmp_path / "events.parquet"))
    writer = stream.writeStream.foreachBatch(lambda d, no: seen.append((d.rdd.getNumPartitions(), [tuple(r) for r in d.collect()])))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= 3 and sorted((r for _, batch in seen for r in batch), key=repr) == sorted(rows, key=repr)
    assert max(parts for parts, _ in seen) > 1
    spans = [[t or datetime.min for _, t in batch] for _, batch in seen if batch]
    assert all(max(a) <= min(b) for a, b in zip(spans, spans[1:]))
