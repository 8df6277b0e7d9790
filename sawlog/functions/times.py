"""Timestamps and durations."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, functions as F

from sawlog.functions.binding import let
from sawlog.functions.text import trim_space

# Accepted timestamp layouts, as patterns. A fraction may follow any seconds.
_CLOCK = r"\d{1,2}:\d{2}:\d{2}([.,]\d+)?"
ISO_LAYOUT = rf"^\d{{4}}-\d{{2}}-\d{{2}}(T{_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})?| +{_CLOCK})\z"
ACCESS_LOG_LAYOUT = rf"^\d{{2}}/[A-Za-z]{{3}}/\d{{4}}:{_CLOCK} +[+-]\d{{4}}\z"
SYSLOG_LAYOUT = rf"^[A-Za-z]{{3}} +\d{{2}} +{_CLOCK}\z"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Duration units in nanoseconds.
UNIT_NANOS = {
    "ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6,
    "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9,
}
_DURATION = r"^[-+]?((\d+(\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h))+\z"
_DURATION_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"


def _month(name: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))
    return F.when(place > 0, F.lpad(place.cast("string"), 2, "0"))


def tidy_ts(text: Column) -> Column:
    """Timestamp text as ``parse_tidy_ts`` takes it: trimmed, with a point before the fraction."""
    return F.replace(trim_space(text), F.lit(","), F.lit("."))


def parse_tidy_ts(s: Column, assume_year: int | None = None) -> Column:
    """``parse_ts`` of text that ``tidy_ts`` has prepared."""
    spaced = F.when(s.contains("  "), F.regexp_replace(s, " +", " ")).otherwise(s)
    # Enough to tell a zone once the layout is known to match.
    zoned = s.endswith("Z") | (s.contains("T") & F.substring(s, -6, 1).isin("+", "-"))
    iso = F.concat(spaced, F.when(zoned, F.lit("")).otherwise(F.lit("Z")))
    access = F.concat(
        F.substring(s, 8, 4), F.lit("-"), _month(F.substring(s, 4, 3)), F.lit("-"), F.substring(s, 1, 2),
        F.lit("T"), F.regexp_replace(F.substr(s, F.lit(13)), r" +([+-]\d{2})(\d{2})\z", "$1:$2"),
    )
    chosen = F.when(s.rlike(ISO_LAYOUT), iso).when(s.rlike(ACCESS_LOG_LAYOUT), access)
    if assume_year is not None:
        syslog = F.concat(
            F.lit(f"{assume_year:04d}-"), _month(F.substring(s, 1, 3)), F.lit("-"),
            F.regexp_replace(F.substr(spaced, F.lit(5)), " ", "T"), F.lit("Z"),
        )
        chosen = chosen.when(s.rlike(SYSLOG_LAYOUT), syslog)
    return chosen.try_cast("timestamp")


def parse_ts(text: Column, assume_year: int | None = None) -> Column:
    """Timestamp in one of the accepted layouts, else null; zone-less text is UTC.

    The layout without a year needs ``assume_year``.
    """
    return let(tidy_ts(text), lambda s: parse_tidy_ts(s, assume_year))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def format_duration(us: Column) -> Column:
    """Short form: ``500ms``, ``59s``, ``1m``, ``1m30s``; anything below a second is cut."""
    secs = (us / 1_000_000).cast("long")
    rest = secs % 60
    minutes = ((secs - rest) / 60).cast("long").cast("string")
    return (
        F.when(us < 1_000_000, F.concat((us / 1000).cast("long").cast("string"), F.lit("ms")))
        .when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
        .when(rest == 0, F.concat(minutes, F.lit("m")))
        .otherwise(F.concat(minutes, F.lit("m"), rest.cast("string"), F.lit("s")))
    )


def full_duration(us: Column) -> Column:
    """Canonical form: ``0s``, ``1.5ms``, ``250µs``, ``5m0s``, ``1h0m0s``."""
    size = F.abs(us)
    sign = F.when(us < 0, F.lit("-")).otherwise(F.lit(""))
    secs = (size - size % 1_000_000) / 1_000_000
    secs = secs.cast("long")
    hours = ((secs - secs % 3600) / 3600).cast("long")
    minutes = (((secs % 3600) - secs % 60) / 60).cast("long")

    def decimal(whole: Column, part: Column, digits: int) -> Column:
        tail = F.rtrim(F.lpad(part.cast("string"), digits, "0"), F.lit("0"))
        return F.concat(whole.cast("string"), F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail)))

    seconds = F.concat(decimal(secs % 60, size % 1_000_000, 6), F.lit("s"))
    millis = F.concat(decimal(((size - size % 1000) / 1000).cast("long"), size % 1000, 3), F.lit("ms"))
    return F.concat(
        sign,
        F.when(size == 0, F.lit("0s"))
        .when(size < 1000, F.concat(size.cast("string"), F.lit("µs")))
        .when(size < 1_000_000, millis)
        .when(secs < 60, seconds)
        .when(secs < 3600, F.concat(minutes.cast("string"), F.lit("m"), seconds))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds)),
    )


def parse_duration(text: Column) -> Column:
    """Duration text such as ``1h30m`` or ``1.5s`` to microseconds; null when malformed."""
    parts = F.regexp_extract_all(text, F.lit(_DURATION_PART), F.lit(0))

    def nanos(part: Column) -> Column:
        unit = F.regexp_extract(part, r"[^0-9.]+\z", 0)
        scale = F
        for name, size in UNIT_NANOS.items():
            scale = scale.when(unit == name, F.lit(size))
        number = F.regexp_extract(part, r"^[0-9.]+", 0)
        whole = F.regexp_extract(number, r"^(\d*)", 1)
        frac = F.substring(F.rpad(F.regexp_extract(number, r"\.(\d*)", 1), 9, "0"), 1, 9)
        whole_ns = F.when(whole == "", F.lit(0)).otherwise(whole.try_cast("decimal(19,0)")) * scale
        frac_ns = F.floor(frac.cast("decimal(19,0)") * scale / F.lit(10**9).cast("decimal(10,0)"))
        return (whole_ns + frac_ns).try_cast("decimal(38,0)")

    total = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda acc, p: (acc + nanos(p)).cast("decimal(38,0)"))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    in_range = F.abs(signed) <= F.lit(2**63 - 1)
    us = (signed / F.lit(1000)).try_cast("long")
    return F.when(text.isin("0", "+0", "-0"), F.lit(0).cast("long")).when(text.rlike(_DURATION) & in_range, us)


def duration_us(text: str | int) -> int:
    """Duration literal to microseconds: an integer is taken as microseconds."""
    if isinstance(text, int):
        return text
    body = text.lstrip("+-")
    if body == "0":
        return 0
    parts = re.findall(_DURATION_PART, body)
    if not parts or "".join(number + unit for number, unit in parts) != body:
        raise ValueError(f"invalid duration {text!r}")
    nanos = sum(int(Fraction(number) * UNIT_NANOS[unit]) for number, unit in parts)
    return (-nanos if text.startswith("-") else nanos) // 1000


def relative_time(ts: Column, now: Column) -> Column:
    """``5s ago``, ``3m ago``, ``2h ago``, ``4d ago``."""
    secs = F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 1000)
    minutes, hours = F.floor(secs / 60), F.floor(F.floor(secs / 60) / 60)
    days = F.floor(hours / 24)

    def ago(count: Column, unit: str) -> Column:
        return F.concat(count.cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(secs < 60, ago(secs, "s")).when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h")).otherwise(ago(days, "d"))
    )
