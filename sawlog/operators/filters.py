"""Filters and searches over parsed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from sawlog.functions.levels import level_rank, priority_number, rank_of
from sawlog.functions.regexes import MAX_FILTER_PATTERN, RegexError, checked_regexes
from sawlog.operators.matching import constant, sought_texts, with_hits

SEARCH_SCHEMA = "struct<levels:array<string>,sources:array<string>,regex:string,_bad:string>"


def filter_level(df: DataFrame, min_level: str | None) -> DataFrame:
    """Lines of at least the level; an empty or unknown level keeps all, as does one on the line."""
    least = rank_of(min_level)
    if least is None:
        return df
    rank = level_rank(F.col("level"))
    return df.where(rank.isNull() | (rank >= least))


def filter_regex(df: DataFrame, pattern: str | None, max_bytes: int | None = MAX_FILTER_PATTERN) -> DataFrame:
    """Lines whose message contains a match; an invalid pattern, or one longer than ``max_bytes`` unless that is None, raises at once."""
    if not pattern:
        return df
    if max_bytes is not None and len(pattern.encode()) > max_bytes:
        raise RegexError(f"regex pattern too long ({len(pattern.encode())} bytes, max {max_bytes})")
    java, = checked_regexes(df.sparkSession, [pattern])
    return df.where(F.col("message").rlike(java))


def filter_logs(df: DataFrame, min_level: str | None = None, pattern: str | None = None) -> DataFrame:
    return filter_regex(filter_level(df, min_level), pattern)


def subscribe(df: DataFrame, level: str | None = None, source: str | None = None) -> DataFrame:
    """Lines a live subscriber sees: exact source, level from ``level`` on.

    Levels on lines count as written, so ``ERROR`` is unknown and passes.
    """
    if source:
        df = df.where(F.col("source") == source)
    least = rank_of(level) if level and level == level.lower() else None
    if least is None:
        return df
    rank = level_rank(F.col("level"), ignore_case=False)
    return df.where(rank.isNull() | (rank >= least))


def webhook_min_level(df: DataFrame, min_level: str | None) -> DataFrame:
    """Lines of at least the level, where a line of unknown level counts as the lowest."""
    if not min_level:
        return df
    least = rank_of(min_level)
    if least is None:
        raise ValueError(f"invalid min_level {min_level!r}")
    return df.where(F.coalesce(level_rank(F.col("level")), F.lit(0)) >= least)


def _search_tests(df: DataFrame, levels, sources, regex) -> list[Column]:
    tests = []
    if levels:
        tests.append(F.lower("level").isin(*levels))
    if sources:
        tests.append(F.col("source").isin(*sources))
    if regex:
        try:
            java, = checked_regexes(df.sparkSession, [regex])
            tests.append(F.col("message").rlike("(?i)" + java))
        except RegexError:
            pass  # a search with a broken pattern ignores it
    return tests


def search_logs(
    df: DataFrame, levels: list[str] = (), sources: list[str] = (), regex: str | None = None
) -> DataFrame:
    """Lines in all given sets, with a case-insensitive pattern; lines without level and message are left out."""
    shown = df.where((F.coalesce("message", F.lit("")) != "") | (F.coalesce("level", F.lit("")) != ""))
    return reduce(DataFrame.where, _search_tests(df, levels, sources, regex), shown)


def _read_searches(searches: DataFrame) -> list[Row]:
    """Saved searches with decoded filters; one that does not decode is reported, not taken as matching all."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = searches.select("name", F.from_json("filters", SEARCH_SCHEMA, options).alias("f")).collect()
    broken = [row.name for row in rows if row.f is not None and row.f._bad is not None]
    if broken:
        raise ValueError(f"saved searches with broken filters: {broken}")
    return rows


def run_saved_search(df: DataFrame, searches: DataFrame, name: str) -> DataFrame:
    """The lines of one saved search; ``searches`` has ``name`` and ``filters`` as JSON."""
    rows = _read_searches(searches.where(F.col("name") == name).limit(1))
    if not rows:
        raise KeyError(f"no saved search {name!r}")
    filters = rows[0].f
    if filters is None:
        return search_logs(df)
    return search_logs(df, filters.levels or (), filters.sources or (), filters.regex)


def run_saved_searches(df: DataFrame, searches: DataFrame) -> DataFrame:
    """Every line with each saved search it is in, as ``search``; all are tested in one pass over the lines.

    Of many searches with a pattern only those are tried on a line of which it holds a required text.
    """
    bound = _read_searches(searches)
    shown = search_logs(df)
    if not bound:
        return shown.select("*", F.lit(None).cast("string").alias("search")).where(F.lit(False))
    java = {}
    for no, row in enumerate(bound):
        if row.f is not None and row.f.regex:
            try:
                java[no], = checked_regexes(df.sparkSession, [row.f.regex])
            except RegexError:
                pass  # a search with a broken pattern ignores it
    needed = sought_texts({no: bound[no].f.regex for no in java})
    tests = {}
    for no, row in enumerate(bound):
        f = row.f
        if no not in needed:
            asked = _search_tests(df, f.levels, f.sources, f.regex) if f else []
            tests[no] = reduce(lambda a, b: a & b, asked, F.lit(True))
    met = with_hits(shown, tests, needed, {no: "(?i)" + java[no] for no in needed})
    for name, value in (("levels", F.lower("level")), ("sources", F.col("source"))) if needed else ():
        lists = constant([(row.f[name] or None) if no in needed else None for no, row in enumerate(bound)], "array<string>")
        allowed = F.get(lists, F.col("_hit"))
        met = met.where(allowed.isNull() | F.array_contains(allowed, value))
    names = constant([row.name for row in bound], "string")
    return met.select(*shown.columns, F.get(names, F.col("_hit")).alias("search"))


def filter_status(health: DataFrame, status: str) -> DataFrame:
    return health.where(F.col("status") == status)


def journal_priority(df: DataFrame, name: str, column: str = "priority") -> DataFrame:
    """Journal entries at least as urgent as the named syslog priority."""
    return df.where(F.col(column).try_cast("int").between(0, priority_number(name)))
