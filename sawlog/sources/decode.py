"""Line formats of containers, the system journal and pods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sawlog.functions.levels import priority_level
from sawlog.functions.text import is_safe_name, strip_ansi, trim_space
from sawlog.functions.times import ISO_LAYOUT, parse_ts
from sawlog.schema import FIELDS_TYPE

# The journal fields kept, and the width of a container timestamp.
JOURNAL_FIELDS = ["_HOSTNAME", "_SYSTEMD_UNIT", "_PID", "_UID", "SYSLOG_IDENTIFIER", "_COMM", "_EXE"]
STAMP_WIDTH = 30
# The label selectors that are accepted, as terms ``key``, ``key=value``, ``key!=value`` and
# ``key in (a, b)`` or ``key not in (a, b)``, joined by commas; and the longest of them.
_TERM = r"[a-zA-Z0-9_./-]+(=[a-zA-Z0-9_./-]+|!=[a-zA-Z0-9_./-]+| (not)?in \([a-zA-Z0-9_.,/ -]+\))?"
SAFE_SELECTOR = rf"^{_TERM}(,{_TERM})*\z"
MAX_SELECTOR_BYTES = 1024


def decode_container_lines(df: DataFrame, container: str = "container") -> DataFrame:
    """Split container log lines: 30-character timestamp to ``env_ts``, terminal colours dropped.

    A prefix of any other width is not a timestamp. ``source`` becomes ``docker:<container>``.
    """
    # Width is counted in bytes; a timestamp is plain ASCII, so characters agree where it matters.
    stamp = F.substring("raw", 1, STAMP_WIDTH)
    zoned = stamp.rlike(ISO_LAYOUT) & stamp.contains("T") & stamp.rlike(r"(Z|[+-]\d{2}:\d{2})\z")
    env_ts = F.when((F.substring("raw", STAMP_WIDTH + 1, 1) == " ") & zoned, parse_ts(stamp))
    step = df.where(F.col("raw") != "").withColumn("env_ts", env_ts)
    rest = F.when(F.col("env_ts").isNotNull(), F.substr("raw", F.lit(STAMP_WIDTH + 2))).otherwise(F.col("raw"))
    return step.withColumns({
        "raw": trim_space(strip_ansi(rest)),
        "source": F.concat(F.lit("docker:"), F.col(container)),
        "env_level": F.lit("info"),
    })


def decode_journal_json(df: DataFrame, unit: str | None = None) -> DataFrame:
    """Journal entries in JSON: message, time, level and the useful fields.

    Only string values count; a line that is no JSON object stays as it is, at level ``info``.
    """
    # Text after the object makes a journal line invalid, unlike in a log line.
    whole = F.col("raw").rlike(r"(?s)^[\t\n\r ]*\{.*\}[\t\n\r ]*\z")
    step = df.withColumn("_entry", F.when(whole, F.try_parse_json("raw").cast(FIELDS_TYPE)))

    def text(key: str):
        value = F.col("_entry")[key]
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    # Leading digits count, as in scanning a number off the front of the text.
    number = F.regexp_extract(text("__REALTIME_TIMESTAMP"), r"^\s*([+-]?\d+)", 1).try_cast("long")
    keys = F.map_filter("_entry", lambda k, _: k.isin(*JOURNAL_FIELDS))
    fields = F.coalesce(F.transform_keys(keys, lambda k, _: F.lower(k)), F.create_map().cast(FIELDS_TYPE))
    is_entry = F.col("_entry").isNotNull()
    out = step.withColumns({
        "priority": text("PRIORITY"),
        "env_ts": F.when(number.isNotNull(), F.timestamp_micros(number)),
        "env_level": F.when(text("PRIORITY").isNotNull(), priority_level(text("PRIORITY"))).otherwise(F.lit("info")),
        "env_fields": fields,
        "raw": F.when(is_entry, F.coalesce(text("MESSAGE"), F.lit(""))).otherwise(F.col("raw")),
    }).drop("_entry")
    return out if unit is None else out.withColumn("source", F.concat(F.lit("journalctl:"), F.lit(unit)))


def label_pod_source(df: DataFrame, namespace: str = "namespace", pod: str = "pod", selector: str = "selector") -> DataFrame:
    """Add ``source``: ``k8s:[ns/]pod`` or ``k8s:[ns/]selector=…``.

    Null for rows with both or neither of pod and selector, or with an unsafe name.
    """
    ns, name, chosen = (F.coalesce(c, F.lit("")) for c in (namespace, pod, selector))
    scope = F.when(ns == "", F.lit("")).otherwise(F.concat(ns, F.lit("/")))
    safe_selector = chosen.rlike(SAFE_SELECTOR) & (F.octet_length(chosen) <= MAX_SELECTOR_BYTES)
    target = (
        F.when((chosen == "") & is_safe_name(name), name)
        .when((name == "") & safe_selector, F.concat(F.lit("selector="), chosen))
    )
    usable = (ns == "") | is_safe_name(ns)
    return df.withColumn("source", F.when(usable, F.concat(F.lit("k8s:"), scope, target)))
