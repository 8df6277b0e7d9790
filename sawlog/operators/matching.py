"""Lines against alert rules."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from sawlog.functions.levels import level_rank, rank_of
from sawlog.functions.literals import holders, required_texts
from sawlog.functions.regexes import checked_regexes
from sawlog.functions.times import full_duration
from sawlog.schema import RULE_SCHEMA

LINE_RULES = ("pattern", "level", "error_rate")
RULE_TYPES = (*LINE_RULES, "health_change")
TESTS_PER_ARRAY = 64  # keeps each generated expression small; all arrays are made in one pass
FEW_PATTERNS = 64  # up to here each line is tried against every pattern


class RuleError(ValueError):
    """A rule set that cannot be compiled; no rule of it is used."""


def bind_rules(rules: DataFrame) -> list[Row]:
    """Read a rule table to the driver and check it. One bad rule rejects the whole set."""
    bound = rules.select(*RULE_SCHEMA.fieldNames()).collect()
    names = [rule.name for rule in bound]
    if len(set(names)) < len(names):
        raise RuleError("rule names must be unique")
    for rule in bound:
        if rule.type not in RULE_TYPES:
            raise RuleError(f"alert rule {rule.name!r}: unknown rule type {rule.type!r}")
        if rule.type == "level" and rank_of(rule.level) is None:
            raise RuleError(f"alert rule {rule.name!r}: invalid level {rule.level!r}")
    return bound


def _fires(rule: Row, java_pattern: str | None) -> Column:
    """Whether one rule sees a line; the cheap tests come first."""
    tests = []
    if rule.source:
        tests.append(F.col("source") == rule.source)
    if rule.type == "pattern":
        tests.append(F.col("message").rlike(java_pattern))
    else:
        least = rank_of(rule.level) if rule.type == "level" else rank_of("error")
        tests.append(F.col("_rank") >= least)
    return reduce(lambda a, b: a & b, tests)


def sought_texts(patterns: dict[int, str]) -> dict[int, set[str]]:
    """Of many numbered patterns those that need a text, with the texts; of few none, as trying them all is cheaper."""
    if len(patterns) <= FEW_PATTERNS:
        return {}
    needed = {no: required_texts(pattern) for no, pattern in patterns.items()}
    return {no: texts for no, texts in needed.items() if texts}


def with_hits(df: DataFrame, tests: dict[int, Column], needed: dict[int, set[str]], confirm: dict[int, str]) -> DataFrame:
    """Each line with ``_hit``, the number of each test it meets, in one pass.

    Tests whose number is in ``needed`` are tried only where one of their texts occurs in the message, all texts being
    looked for at once; ``confirm`` has the patterns of just those, and what else they ask for is left to the caller.
    """
    hits = [F.when(test, F.lit(no)) for no, test in tests.items() if no not in needed]
    found = compacted(hits) if hits else F.array().cast("array<int>")
    if not needed:
        return df.select("*", F.explode(found).alias("_hit"))
    patterns = constant([confirm.get(no) for no in range(max(needed) + 1)], "string")
    both = df.select("*", F.explode(F.concat(found, holders(F.col("message"), needed))).alias("_hit"))
    pattern = F.get(patterns, F.col("_hit"))
    return both.where(pattern.isNull() | F.rlike(F.col("message"), pattern))


def match_rules(lines: DataFrame, rules: DataFrame | list[Row]) -> DataFrame:
    """Each line with each line rule it meets: the line's columns, ``rule_no`` and the rule's.

    The rule set, of any size the driver holds, is bound into the plan, one literal test per rule,
    so no join is needed and a hot source costs nothing. All rules are tested in one pass over the lines; of more than
    ``FEW_PATTERNS`` patterns only those are tried on a line of which it holds a required text. Order of rules is kept in ``rule_no``.
    """
    bound = rules if isinstance(rules, list) else bind_rules(rules)
    numbered = [(no, r) for no, r in enumerate(bound) if r.type in LINE_RULES]
    patterns = [r.pattern or "" for _, r in numbered if r.type == "pattern"]
    java = iter(checked_regexes(lines.sparkSession, patterns))
    tests = [(no, r, next(java) if r.type == "pattern" else None) for no, r in numbered]
    ranked = lines.withColumn("_rank", level_rank(F.col("level")))
    needed = sought_texts({i: r.pattern for i, (_, r, _) in enumerate(tests) if r.type == "pattern" and r.pattern})
    return _matched(ranked, tests, needed).drop("_rank")


def compacted(cases: list[Column]) -> Column:
    """An array of the cases that are not null, made of several small ones."""
    parts = [F.array_compact(F.array(*cases[i:i + TESTS_PER_ARRAY])) for i in range(0, len(cases), TESTS_PER_ARRAY)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def constant(values: list, ddl: str) -> Column:
    """An array of constants of any length, bound into the plan as one literal that is read once."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{ddl}>")


_RULE_DDL = "struct<rule_no:int," + ",".join(f"rule_{f.name}:{f.dataType.simpleString()}" for f in RULE_SCHEMA) + ">"


def _rule_values(no: int, rule: Row) -> dict:
    return {"rule_no": no, **{f"rule_{f.name}": rule[f.name] for f in RULE_SCHEMA}}


def _matched(ranked: DataFrame, tests: list, needed: dict[int, set[str]]) -> DataFrame:
    table = constant([_rule_values(no, r) for no, r, _ in tests], _RULE_DDL)
    if not tests:
        return ranked.select("*", F.get(table, F.lit(0)).alias("_rule")).where(F.lit(False)).select(*ranked.columns, "_rule.*")
    fires = {i: _fires(r, j) for i, (_, r, j) in enumerate(tests) if i not in needed}
    exploded = with_hits(ranked, fires, needed, {i: tests[i][2] for i in needed})
    if needed:
        source = F.get(constant([r.source or None for _, r, _ in tests], "string"), F.col("_hit"))
        exploded = exploded.where(source.isNull() | (F.col("source") == source))
    return exploded.select(*ranked.columns, F.get(table, F.col("_hit")).alias("_rule")).select(
        *ranked.columns, "_rule.*"
    )


def alert_message(rule_type: Column, level: Column, message: Column, count: Column, window_us: Column) -> Column:
    """Text of an alert event."""
    return (
        F.when(rule_type == "pattern", F.concat(F.lit("Pattern matched: "), message))
        .when(rule_type == "level", F.concat(F.lit("["), F.upper(level), F.lit("] "), message))
        .otherwise(F.concat(
            F.lit("Error rate exceeded: "), count.cast("string"), F.lit(" errors in "), full_duration(window_us)
        ))
    )


def health_rule_match(transitions: DataFrame, rules: DataFrame) -> DataFrame:
    """Health-change events ``(rule_name, severity, message, source, count, fired_at, seq, cooldown_us)``."""
    bound = [(no, r) for no, r in enumerate(bind_rules(rules)) if r.type == "health_change"]
    if not bound:
        table = F.array().cast("array<struct<rule_name:string,severity:string,cooldown_us:bigint>>")
    else:
        table = compacted([
            F.when(
                F.lit(True) if not r.source else F.col("source") == r.source,
                F.struct(
                    F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"),
                    F.lit(r.cooldown_us).cast("bigint").alias("cooldown_us"),
                ),
            )
            for _, r in bound
        ])
    return transitions.select("*", F.explode(table).alias("_rule")).select(
        "_rule.rule_name", "_rule.severity", "message", "source", F.lit(0).cast("bigint").alias("count"),
        F.col("ts").alias("fired_at"), "seq", "_rule.cooldown_us",
    )
