"""Text clean-up, names and rendered lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode White_Space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
SAFE_LABEL = r"^[a-zA-Z0-9/_.:@-]+\z"
SAFE_NAME = r"^[a-zA-Z0-9][a-zA-Z0-9._:@-]*\z"
MAX_NAME_BYTES = 256
ANSI_SEQUENCE = "\x1b\\[[0-9;]*[a-zA-Z]"


def trim_space(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def cut_bytes(text: Column, size: int) -> Column:
    """First ``size`` bytes; a character broken by the cut decodes to U+FFFD."""
    data = F.encode(text, "UTF-8")
    cut = F.substring(data, 1, size)
    return F.when(F.octet_length(text) <= size, text).otherwise(_decode_lossy(cut))


def _decode_lossy(data: Column) -> Column:
    # make_valid_utf8 replaces broken sequences, where decode() raises.
    return F.make_valid_utf8(data.cast("string"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_SEQUENCE, "")


def sanitize_label(text: Column, size: int = 128) -> Column:
    """Trimmed, cut metric label; ``unknown`` when unsafe characters are left."""
    label = cut_bytes(trim_space(text), size)
    return F.when(label.rlike(SAFE_LABEL), label).otherwise(F.lit("unknown"))


def sanitize_text(text: Column, size: int = 128) -> Column:
    """Trimmed, cut text without control characters."""
    return F.regexp_replace(cut_bytes(trim_space(text), size), r"[\x00-\x1f\x7f]", "")


def is_safe_name(text: Column) -> Column:
    return (F.octet_length(text) <= MAX_NAME_BYTES) & text.rlike(SAFE_NAME)


def safe_source_name(text: Column) -> Column:
    """Every character outside ``a-zA-Z0-9._-`` becomes ``-``; empty is ``unknown``."""
    name = F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "-")
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def derive_source_name(path: Column) -> Column:
    """``parent-base`` without extension, from a file path."""
    base = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    parent = F.regexp_extract(path, r"([^/]+)/+[^/]+/*\z", 1)
    stem = F.regexp_replace(base, r"\.[^.]*\z", "")
    name = F.when(stem == "", base).otherwise(stem)
    prefixed = F.when(parent.isin("", ".", "log"), name).otherwise(F.concat(parent, F.lit("-"), name))
    return safe_source_name(prefixed)


def format_line(ts: Column, source: Column, level: Column, message: Column) -> Column:
    """``[yyyy-MM-dd HH:mm:ss] [source] LEVEL: message``"""
    return F.concat(
        F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), source, F.lit("] "),
        F.upper(level), F.lit(": "), message,
    )


def resolve_index(pattern: str, ts: Column) -> Column:
    """Index name with its ``%{+YYYY.MM.dd}``-style date parts filled in (UTC)."""
    name = F.lit(pattern)
    for token, layout in [
        ("%{+YYYY.MM.dd}", "yyyy.MM.dd"), ("%{+YYYY.MM}", "yyyy.MM"), ("%{+YYYY}", "yyyy"),
    ]:
        if token in pattern:
            name = F.replace(name, F.lit(token), F.date_format(ts, layout))
    return name


def render_alert(severity: Column, rule: Column, message: Column, source: Column) -> Column:
    """Console line of an alert event."""
    tag = F.when(severity == "critical", F.lit("[ALERT][CRITICAL] ")).otherwise(F.lit("[ALERT][WARNING] "))
    origin = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit(" (source: "), source, F.lit(")")))
    return F.concat(tag, rule, F.lit(": "), message, F.coalesce(origin, F.lit("")))


def alert_email_subject(severity: Column, rule: Column, app: str = "Sawlog") -> Column:
    return F.concat(F.lit(f"[{app}]["), F.upper(severity), F.lit("] "), rule)


def alert_email_body(
    rule: Column, severity: Column, source: Column, fired_at: Column, message: Column, count: Column
) -> Column:
    tail = F.when(count > 0, F.concat(F.lit("\nCount: "), count.cast("string"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("Rule: "), rule, F.lit("\nSeverity: "), severity,
        F.lit("\nSource: "), F.coalesce(source, F.lit("")),
        F.lit("\nTime: "), F.date_format(fired_at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC\n\n"),
        message, tail,
    )
