import os
from datetime import datetime

import pytest

from sawlog.operators import history
from sawlog.sinks import files
from sawlog.sinks.alerts import append_alert_events

SCHEMA = "id string, rule_name string, severity string, message string, source string, count long, fired_at timestamp, acknowledged_at timestamp"


def events(spark, rows):
    return spark.createDataFrame([(i, "r", "critical", "m", "s", 0, at, None) for i, at in rows], SCHEMA)


ROWS = [("a", datetime(2024, 1, 1, 5)), ("b", datetime(2024, 1, 2, 5)), ("c", datetime(2024, 1, 2, 15)), ("d", datetime(2024, 1, 3, 5)), ("n", None)]


@pytest.fixture
def place(spark, tmp_path):
    path = str(tmp_path / "hist")
    append_alert_events(events(spark, ROWS), path)
    return path


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_events_without_a_time_are_stored_once(spark, place):
    for _ in range(3):
        append_alert_events(events(spark, ROWS), place)
    assert ids(spark, place) == ["a", "b", "c", "d", "n"]


class Stop(Exception):
    pass


@pytest.mark.parametrize("stop", range(6))
def test_a_purge_that_is_stopped_loses_nothing(spark, place, monkeypatch, stop):
    """Stopped after any step, the history has all that is to stay once the next call has run."""
    steps = []

    def stopping(name):
        real = getattr(files, name)

        def run(*args, **kwargs):
            if len(steps) == stop:
                raise Stop
            steps.append(name)
            return real(*args, **kwargs)

        return run

    now = datetime(2024, 2, 1, 12)  # 30 days before is noon of January 2
    with monkeypatch.context() as patch:
        patch.setattr(files, "_mark", stopping("_mark"))
        patch.setattr(files, "finish_swaps", stopping("finish_swaps"))
        patch.setattr(history, "drop_old_days", stopping("drop_old_days"))
        try:
            history.purge_stored(spark, place, now)
        except Stop:
            pass
    left = ids(spark, place)
    assert {"c", "d", "n"} <= set(left)
    history.purge_stored(spark, place, now)
    assert ids(spark, place) == ["c", "d", "n"]
    assert not [name for name in os.listdir(place) if name.startswith(files.SWAP)]


def test_a_switch_that_is_stopped_is_gone_through_with(spark, place, tmp_path):
    """The old day is aside and the new one not yet in its place: the worst moment."""
    swap = f"{place}/{files.SWAP}x"
    kept = spark.read.parquet(place).where("id = 'c'")
    kept.write.partitionBy("fired_on").parquet(f"{swap}/new")
    files._mark(spark, f"{swap}/{files.READY}", ["2024-01-02"])
    os.makedirs(f"{swap}/old")
    os.rename(f"{place}/fired_on=2024-01-02", f"{swap}/old/fired_on=2024-01-02")
    assert ids(spark, place) == ["a", "d", "n"]
    append_alert_events(events(spark, ROWS[:1]), place)
    assert ids(spark, place) == ["a", "c", "d", "n"]


def test_a_new_day_that_was_not_finished_is_dropped(spark, place):
    spark.read.parquet(place).where("id = 'c'").write.partitionBy("fired_on").parquet(f"{place}/{files.SWAP}x/new")
    append_alert_events(events(spark, ROWS), place)
    assert ids(spark, place) == ["a", "b", "c", "d", "n"] and not os.path.exists(f"{place}/{files.SWAP}x")


def test_stored_events_are_acknowledged_once(spark, place):
    before = {name: os.listdir(f"{place}/{name}") for name in os.listdir(place) if name.startswith("fired_on")}
    ask = lambda *names: {r.id: r.found for r in history.acknowledge_stored(
        spark, place, spark.createDataFrame([(x,) for x in names], "id string"), datetime(2024, 3, 1)).collect()}
    assert ask("b", "n", "zz") == {"b": True, "n": True, "zz": False}
    assert ask("b", "c") == {"b": False, "c": True}
    rows = {r.id: r.acknowledged_at for r in spark.read.parquet(place).collect()}
    assert sorted(rows) == ["a", "b", "c", "d", "n"] and [k for k, at in sorted(rows.items()) if at] == ["b", "c", "n"]
    # Days that are not touched keep their files.
    for day in ("2024-01-01", "2024-01-03"):
        assert os.listdir(f"{place}/fired_on={day}") == before[f"fired_on={day}"]
