"""Many patterns at once give what one by one gives."""

import re
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sawlog.functions.literals import holders, required_texts
from sawlog.operators import matching
from sawlog.operators.filters import run_saved_searches
from sawlog.operators.matching import match_rules
from sawlog.schema import RULE_SCHEMA

LINES = "line_id long, ts timestamp, level string, message string, source string"


@pytest.mark.parametrize("pattern, texts", [
    ("disk full", {"disk full"}), ("Timeout|refused", {"timeout", "refused"}), ("time(out|r)", {"time"}), ("abc*", None), ("abcd*x", {"abc"}),
    ("(?:error: )?retry", {"retry"}), ("(?i)error", None), (r"\d+ ms", {" ms"}), (r"a\.log$", {"a.log"}), ("[]x]queue", {"queue"}),
    (r"\Qa.b\E", None), ("", None), ("abc|.", None), ("x{2}abc", {"abc"}), ("abcd{0,2}efg", {"abc"}), ("a{b", {"a{b"}), ("ab+cde", {"cde"}),
    ("[[:alpha:]]full", {"full"}), ("(abc|defg)+", {"abc", "defg"}), ("(abc)*", None), (r"\x41bcd", None), ("Größe", {"größe"}),
])
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == texts


ATOMS = st.sampled_from(["abc", "b", "c", ".", "[ab]", r"\d", r"\.", "B", " ", "(?:abc|bca)", "(ab|c)", "(abcab)"])
PIECES = st.tuples(ATOMS, st.sampled_from(["", "", "", "*", "+", "?", "{2}", "{0,1}", "+?"])).map("".join)
PATTERNS = st.lists(st.lists(PIECES, min_size=1, max_size=5).map("".join), min_size=1, max_size=2).map("|".join)


@settings(max_examples=1500, deadline=None)
@given(PATTERNS, st.text("abcB .1", max_size=30))
def test_a_match_holds_a_required_text(pattern, text):
    texts = required_texts(pattern)
    if texts and re.search(pattern, text, re.ASCII):
        assert any(t in text.lower() for t in texts)


MESSAGES = [None, "", "code 7", "CODE 70 failed", "code 171: Größe", "nothing", "x code 3 code 4", "retry code 12 of 99", "ſcode 5"]


def lines(spark):
    rows = [(i, datetime(2024, 1, 1), "error" if i % 2 else "info", m, "ab"[i % 3 == 0]) for i, m in enumerate(MESSAGES)]
    return spark.createDataFrame(rows, LINES)


def test_many_rules_give_what_each_gives(spark, monkeypatch):
    made = [(f"r{i}", "pattern", "warning", [f"code {i}", f"code {i}$", f"(?i)CODE {i}", f"code {i}|Größe{i}", r"\d\d$", "Größe"][i % 6],
             None, "a" if i % 4 == 0 else None, None, None, 0) for i in range(200)]
    made.append(("level", "level", "warning", None, "error", None, None, None, 0))
    rules = spark.createDataFrame(made, RULE_SCHEMA)
    found = {(r.line_id, r.rule_no, r.rule_name) for r in match_rules(lines(spark), rules).collect()}
    assert match_rules(lines(spark), rules).columns == [*lines(spark).columns, "rule_no", *[f"rule_{f.name}" for f in RULE_SCHEMA]]
    monkeypatch.setattr(matching, "FEW_PATTERNS", 10**9)
    assert found and found == {(r.line_id, r.rule_no, r.rule_name) for r in match_rules(lines(spark), rules).collect()}


def test_many_searches_give_what_each_gives(spark, monkeypatch):
    filters = ['{"regex":"CODE %d"}', '{"regex":"code %d","levels":["error"]}', '{"regex":"code %d","sources":["b"]}', '{"regex":"(code %d"}', '{"levels":["info"]}']
    rows = [(f"s{i}", filters[i % 5].replace("%d", str(i))) for i in range(200)]
    searches = spark.createDataFrame(rows, "name string, filters string")
    found = sorted((r.line_id, r.search) for r in run_saved_searches(lines(spark), searches).collect())
    monkeypatch.setattr(matching, "FEW_PATTERNS", 10**9)
    assert found and found == sorted((r.line_id, r.search) for r in run_saved_searches(lines(spark), searches).collect())
    assert run_saved_searches(lines(spark), searches.limit(0)).collect() == []


def test_texts_that_are_not_valid(spark):
    frame = spark.sql("SELECT CAST(X'FF616263FE' AS STRING) AS m UNION ALL SELECT NULL UNION ALL SELECT 'xABCx'")
    got = frame.select(holders(F.col("m"), {3: {"abc"}, 1: {"bc", "zz"}}).alias("h")).collect()
    assert sorted(r.h for r in got) == [[], [1, 3], [1, 3]]
