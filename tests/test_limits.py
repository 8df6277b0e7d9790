"""What is asked for is given: no caps but those a caller sets."""

from datetime import datetime, timedelta

import pytest

from sawlog.operators.alerts import recent_events
from sawlog.operators.filters import run_saved_search, run_saved_searches
from sawlog.operators.history import list_alert_events
from sawlog.operators.matching import match_rules
from sawlog.schema import RULE_SCHEMA

LINES = "line_id long, ts timestamp, level string, message string, source string"


def lines(spark, n=3):
    return spark.createDataFrame([(i, datetime(2024, 1, 1), "error", f"code {i}", "a") for i in range(n)], LINES)


def test_many_rules_in_one_scan(spark, tmp_path):
    lines(spark).write.parquet(str(tmp_path / "l"))
    table = spark.read.parquet(str(tmp_path / "l"))
    rules = spark.createDataFrame([(f"r{i}", "pattern", "warning", f"code {i}$", None, None, None, None, 0) for i in range(300)], RULE_SCHEMA)
    found = match_rules(table, rules)
    assert sorted((r.line_id, r.rule_name) for r in found.collect()) == [(i, f"r{i}") for i in range(3)]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_limits_of_history(spark):
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(f"{i:05}", "r", "warning", "m", "s", 1, start + timedelta(seconds=i), None) for i in range(6000)],
        "id string, rule_name string, severity string, message string, source string, count long, fired_at timestamp, acknowledged_at timestamp")
    assert list_alert_events(events, limit=5000).count() == 5000
    assert list_alert_events(events, limit=5000, max_limit=1000).count() == 1000
    assert list_alert_events(events).count() == 100
    assert recent_events(events, 500).count() == 500 and recent_events(events).count() == 100
    assert recent_events(events, 500, keep=100).count() == 100


def test_saved_searches(spark):
    rows = [(f"s{i}", f'{{"regex":"code {i}"}}') for i in range(1200)]
    searches = spark.createDataFrame(rows, "name string, filters string")
    assert run_saved_searches(lines(spark, 2), searches).count() >= 2
    broken = spark.createDataFrame([("bad", '{"regex":'), ("all", None)], "name string, filters string")
    with pytest.raises(ValueError, match="bad"):
        run_saved_searches(lines(spark), broken)
    with pytest.raises(ValueError, match="bad"):
        run_saved_search(lines(spark), broken, "bad")
    assert run_saved_search(lines(spark), broken, "all").count() == 3


@pytest.mark.parametrize("fan", [4, 4096])
@pytest.mark.parametrize("spread", ["dense", "hashed", "both"])
def test_numbering_for_any_ids(spark, spread, fan, monkeypatch):
    from pyspark.sql import functions as F

    from sawlog.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 500)
    monkeypatch.setattr(ranking, "FAN", fan)
    ids = {"dense": F.col("id"), "hashed": F.xxhash64("id"), "both": F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.xxhash64("id"))}
    frame = spark.range(20_000).select(ids[spread].alias("k"), F.col("id").alias("x"))
    got = ranking.number_rows(frame, "k", "no").orderBy("k").collect()
    assert [r.no for r in got] == list(range(20_000))
    cuts = ranking._cuts(frame, "k", 20_000)
    sizes = [r["count"] for r in ranking._bucketed(frame, "k", cuts).groupBy("_bucket").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 1_000
    for limit in (700, 30_000):
        top = [r.k for r in ranking.newest(frame, "k", limit).collect()]
        assert top == [r.k for r in got][::-1][:limit]


def test_numbering_computes_its_input_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sawlog.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 200)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(1_000).mapInArrow(count, "id long")
    assert ranking.number_rows(frame, "id", "no").where(F.col("id") != F.col("no")).count() == 0
    assert seen.value == 1_000


def test_equal_batches_are_all_delivered(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from sawlog.sinks.delivery import write_webhook

    same = spark.createDataFrame([(i, datetime(2024, 1, 1), "error", "again", "a") for i in range(40)], LINES)
    for _ in range(2):
        write_webhook(same, {"path": str(tmp_path / "out")}, F.lit("2024-01-01").cast("timestamp"), size=10)
        assert len(os.listdir(tmp_path / "out")) == 4


def test_masked_objects_are_encoded_anew(spark):
    from sawlog.functions.jsonfmt import mask_secrets
    from pyspark.sql import functions as F

    cases = {
        '{"url": "x"}': '{"url":"x"}', '{"b":1,"a":{"Token":"t","n":1e21,"m":0.0000001,"k":1.0}}': '{"a":{"Token":"****","k":1,"m":1e-7,"n":1e+21},"b":1}',
        '{"q":"a<b&c"}': '{"q":"a\\u003cb\\u0026c"}', "[1, 2]": "[1, 2]", "{broken": "{broken", "": "", ' {"secret":"","x":[{"token":"t"}]}': '{"secret":"","x":[{"token":"t"}]}',
    }
    frame = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.m for r in frame.select("c", mask_secrets(F.col("c")).alias("m")).collect()} == cases
