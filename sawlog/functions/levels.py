"""Severity levels and syslog priorities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sawlog.functions.text import trim_space

# Level order, spellings and syslog priorities of the record format.
LEVELS = ["debug", "info", "warn", "error", "fatal"]
LEVEL_ALIASES = {
    "warning": "warn",
    "err": "error",
    "crit": "fatal",
    "critical": "fatal",
    "trace": "debug",
    "information": "info",
}
SYSLOG_PRIORITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
PRIORITY_LEVELS = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]


def _lookup(key: Column, table: dict) -> Column:
    """Value of a small literal table, null for other keys."""
    cells = [F.lit(cell) for pair in table.items() for cell in pair]
    return F.try_element_at(F.create_map(*cells), key)


def rank_of(level: str | None) -> int | None:
    """Rank of a level literal, None when it is not one of the five."""
    name = (level or "").lower()
    return LEVELS.index(name) if name in LEVELS else None


def level_rank(level: Column, ignore_case: bool = True) -> Column:
    """0 (debug) to 4 (fatal), null for anything else."""
    key = F.lower(level) if ignore_case else level
    return _lookup(key, {name: rank for rank, name in enumerate(LEVELS)})


def normalize_level(level: Column) -> Column:
    """One of the five levels; aliases are resolved, unknown text is ``info``."""
    spelled = F.lower(trim_space(level))
    names = LEVEL_ALIASES | {name: name for name in LEVELS}
    return F.coalesce(_lookup(spelled, names), F.lit("info"))


def is_valid_level(level: Column) -> Column:
    """Whether the text is a level or an alias of one."""
    return F.lower(trim_space(level)).isin(*LEVELS, *LEVEL_ALIASES)


def priority_number(name: str) -> int:
    """Syslog priority 0-7 from its name or digit."""
    text = name.strip().lower()
    if text in SYSLOG_PRIORITIES:
        return SYSLOG_PRIORITIES.index(text)
    if text.isdigit() and int(text) < len(SYSLOG_PRIORITIES):
        return int(text)
    raise ValueError(f"unknown syslog priority {name!r}")


def priority_level(priority: Column) -> Column:
    """Level for a syslog priority given as text; unknown text is ``info``."""
    table = {str(i): name for i, name in enumerate(PRIORITY_LEVELS)}
    return F.coalesce(_lookup(priority, table), F.lit("info"))
