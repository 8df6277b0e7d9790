"""Parsing raw lines as JSON, logfmt or text.

Each step adds the columns the next one branches on, so every line is decoded once and the
costlier format is only tried where the cheaper test failed. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.functions.binding import let
from sawlog.functions.jsonfmt import is_number_kind, variant_text
from sawlog.functions.levels import is_valid_level, normalize_level
from sawlog.functions.text import trim_space
from sawlog.functions.times import parse_tidy_ts, parse_ts, tidy_ts
from sawlog.schema import FIELDS_TYPE, MAX_FIELDS, MAX_LINE_BYTES, column_or_null

# The keys a record's timestamp, level and message are looked up under, in order.
TIMESTAMP_KEYS = ["timestamp", "time", "ts", "@timestamp", "datetime"]
LEVEL_KEYS = ["level", "lvl", "severity", "loglevel"]
MESSAGE_KEYS = ["message", "msg", "text", "log"]

# The line patterns, written for Java. SP is white space without vertical tab.
SP = r"[\t\n\f\r ]"
NSP = r"[^\t\n\f\r ]"
PAIR = rf'\w+=(?:"[^"]*"|{NSP}*)'
PAIR_DETECT = rf'\w+=(?:"[^"]*"|{NSP}+)'
_DAY_CLOCK = rf"\d{{4}}-\d{{2}}-\d{{2}}[T\t\n\f\r ]\d{{2}}:\d{{2}}:\d{{2}}"
BRACKETED_HEAD = rf"^\[{_DAY_CLOCK}[^\]]*\]{SP}*\w+:?{SP}*"
SPACED_HEAD = rf"^{_DAY_CLOCK}{NSP}*{SP}+\w+{SP}+"
LEVEL_HEAD = rf"^\w+:?{SP}+"

REASONS = ["empty", "too_large", "invalid_format", "too_many_fields"]


def reject_reason(raw: Column, max_line_bytes: int | None = MAX_LINE_BYTES) -> Column:
    """``empty`` or ``too_large`` for lines no format accepts, else null; without a limit only ``empty``."""
    line = trim_space(raw)
    empty = F.when(F.coalesce(line, F.lit("")) == "", F.lit("empty"))
    return empty if max_line_bytes is None else empty.when(F.octet_length(line) > max_line_bytes, F.lit("too_large"))


def _last_wins(keys: Column, values: Column) -> Column:
    """Map from parallel arrays where the last of equal keys counts; repeats are found by one sort."""
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    last = let(placed, lambda p: F.filter(p, lambda x, j: ~F.get(p, j + 1)["k"].eqNullSafe(x["k"])))
    folded = let(last, lambda kept: F.map_from_arrays(
        F.transform(kept, lambda x: x["k"]), F.transform(kept, lambda x: F.get(values, x["i"]))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(folded)


def add_json_object(df: DataFrame, line: Column, when: Column, out: str) -> DataFrame:
    """Add the object starting at the first brace as ``map<string,variant>``; null if it does not decode.

    Text after the object is ignored. ``from_json`` is only asked when the strict parser
    refuses, which it also does for repeated keys.
    """
    text = F.substr(line, F.instr(line, "{"))
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
    step = df.withColumn("_strict", F.when(when & line.contains("{"), F.try_parse_json(text)))
    refused = F.col("_strict").isNull() & when & line.contains("{") & line.contains(":")
    step = step.withColumn("_loose", F.when(refused, F.from_json(text, FIELDS_TYPE, options)))
    step = step.withColumns({"_loose_keys": F.map_keys("_loose"), "_loose_values": F.map_values("_loose")})
    kept = F.when(F.col("_loose").isNotNull(), _last_wins(F.col("_loose_keys"), F.col("_loose_values")))
    return step.withColumn(out, F.coalesce(F.col("_strict").cast(FIELDS_TYPE), kept))


def add_logfmt_pairs(df: DataFrame, line: Column, when: Column, out: str) -> DataFrame:
    """Add all ``key=value`` pairs as ``map<string,string>``, the last of equal keys counting."""
    step = df.withColumn("_found", F.when(when, F.regexp_extract_all(line, F.lit(f"({PAIR})"), F.lit(1))))
    step = step.withColumns({
        "_pair_keys": F.transform("_found", lambda p: F.substring_index(p, "=", 1)),
        "_pair_values": F.transform("_found", lambda p: _unquoted(F.substr(p, F.instr(p, "=") + 1))),
    })
    return step.withColumn(
        out, F.when(F.col("_found").isNotNull(), _last_wins(F.col("_pair_keys"), F.col("_pair_values")))
    )


def _unquoted(value: Column) -> Column:
    # Only a quoted value both starts and ends with a quote: an open quote has no second one.
    return F.when(value.rlike('^".*"\\z'), F.regexp_extract(value, r'^"([^"]*)"', 1)).otherwise(value)


def is_logfmt(line: Column) -> Column:
    return line.contains("=") & (F.regexp_count(line, F.lit(PAIR_DETECT)) >= 2)


def _first_present(record: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.when(F.map_contains_key(record, k), F.lit(k)) for k in keys])


def _from_seconds(seconds: Column) -> Column:
    # Seconds beyond the microsecond range cannot be a timestamp here.
    return F.when(F.abs(seconds) < 2.0**63 / 1e6, F.timestamp_seconds(seconds.try_cast("long")))


def _variant_ts(value: Column, assume_year: int | None) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", parse_ts(F.try_variant_get(value, "$", "string"), assume_year)).when(
        is_number_kind(kind), _from_seconds(F.try_variant_get(value, "$", "double"))
    )


def _first_parsing(record: Column, parse) -> Column:
    """``struct(key, ts)`` of the first timestamp key whose value parses; for when the first key's does not."""
    present = F.filter(F.array(*map(F.lit, TIMESTAMP_KEYS)), lambda k: F.map_contains_key(record, k))
    parsed = F.transform(present, lambda k: F.struct(k.alias("key"), parse(record[k]).alias("ts")))
    return F.try_element_at(F.filter(parsed, lambda p: p.ts.isNotNull()), F.lit(1))


def _without(record: Column) -> Column:
    return F.map_filter(record, lambda k, _: ~F.array_contains(F.col("_taken"), k))


def parse_logs(
    df: DataFrame,
    fmt: str | Column = "auto",
    auto: str = "compat",
    keep_envelope: bool = True,
    assume_year: int | None = None,
    max_line_bytes: int | None = MAX_LINE_BYTES,
    max_fields: int | None = MAX_FIELDS,
) -> DataFrame:
    """Parse ``raw`` into ``ts, level, message, fields`` plus ``ts_source, format, parse_error``.

    ``fmt`` is ``json``, ``logfmt``, ``text`` or anything else for auto-detection, as a literal
    or a column. With ``auto="strict"`` detection takes JSON or logfmt only when a level or
    message key is there. Optional input columns: ``ingest_ts`` stands in for a missing
    timestamp; ``env_ts``, ``env_level`` and ``env_fields`` come from the reader and fill what the
    body lacks unless ``keep_envelope`` is off. A line that does not parse keeps its raw text as
    message, with the reason in ``parse_error``; among these are lines over ``max_line_bytes`` and
    records of more than ``max_fields`` keys, unless these limits are None.
    """
    if auto not in ("compat", "strict"):
        raise ValueError("auto must be 'compat' or 'strict'")
    given = [c for c in df.columns if c not in ("ts", "ts_source", "level", "message", "fields", "format", "parse_error")]
    wanted = F.lit(fmt) if isinstance(fmt, str) else fmt
    ingest_ts = column_or_null(df, "ingest_ts", "timestamp")
    env_ts = column_or_null(df, "env_ts", "timestamp")
    env_level = column_or_null(df, "env_level", "string")
    env_fields = F.coalesce(column_or_null(df, "env_fields", FIELDS_TYPE).cast(FIELDS_TYPE),
                            F.create_map().cast(FIELDS_TYPE))

    is_json, is_lf, is_text = (F.col("_fmt") == f for f in ("json", "logfmt", "text"))
    is_auto = ~(is_json | is_lf | is_text)
    usable = F.col("_refused").isNull()
    has_key = lambda m: F.coalesce(_first_present(m, LEVEL_KEYS + MESSAGE_KEYS).isNotNull(), F.lit(False))
    convincing = (lambda m: has_key(m) | ~is_auto) if auto == "strict" else (lambda m: F.lit(True))

    step = df.withColumns({"_line": trim_space(F.col("raw")), "_fmt": F.coalesce(F.lower(wanted), F.lit("auto"))})
    step = step.withColumn("_refused", reject_reason(F.col("_line"), max_line_bytes))
    few = lambda m: F.lit(True) if max_fields is None else F.size(m) <= max_fields
    step = add_json_object(step, F.col("_line"), usable & (is_json | is_auto), "_json")
    step = step.withColumn(
        "_is_json", F.col("_json").isNotNull() & few("_json") & convincing(F.col("_json"))
    )
    paired = usable & (is_lf | (is_auto & ~F.col("_is_json") & is_logfmt(F.col("_line"))))
    step = add_logfmt_pairs(step, F.col("_line"), paired, "_pairs")
    step = step.withColumn(
        "_is_pairs", F.col("_pairs").isNotNull() & few("_pairs") & convincing(F.col("_pairs"))
    )
    as_text = usable & ~F.col("_is_json") & ~F.col("_is_pairs") & (is_text | is_auto)
    step = step.withColumn(
        "format",
        F.when(F.col("_is_json"), F.lit("json")).when(F.col("_is_pairs"), F.lit("logfmt")).when(as_text, F.lit("text")),
    )
    step = step.withColumn(
        "parse_error",
        F.coalesce(
            F.col("_refused"),
            F.when(F.col("format").isNotNull(), F.lit(None).cast("string"))
            .when(~few("_json") | ~few("_pairs"), F.lit("too_many_fields"))
            .otherwise(F.lit("invalid_format")),
        ),
    )
    step = _add_text_parts(step)
    step = _add_record_parts(step, assume_year)

    level_found = F.coalesce(F.col("_rec.level"), F.col("_text_level"))
    own_env_ts = env_ts if keep_envelope else F.lit(None).cast("timestamp")
    failed = F.col("parse_error").isNotNull()
    step = step.withColumn("_parsed_ts", F.col("_won.ts"))
    kept_env = env_fields if keep_envelope else F.when(failed, env_fields)
    body_fields = F.coalesce(F.col("_rec.fields"), F.create_map().cast(FIELDS_TYPE))
    fields = F.when(
        F.coalesce(F.size(kept_env), F.lit(0)) <= 0, body_fields
    ).otherwise(
        F.map_concat(F.map_filter(kept_env, lambda k, _: ~F.map_contains_key(body_fields, k)), body_fields)
    )
    env_default = F.coalesce(env_level if keep_envelope else F.when(failed, env_level), F.lit("info"))
    fallback_ts = own_env_ts if keep_envelope else F.when(failed, env_ts)
    record = F.struct(
        F.coalesce("_parsed_ts", fallback_ts, ingest_ts).alias("ts"),
        F.when(F.col("_parsed_ts").isNotNull(), F.lit("body"))
        .when(fallback_ts.isNotNull(), F.lit("envelope"))
        .when(ingest_ts.isNotNull(), F.lit("ingest"))
        .alias("ts_source"),
        F.when(level_found.isNotNull(), normalize_level(level_found)).otherwise(env_default).alias("level"),
        F.when(failed, F.col("raw"))
        .otherwise(F.coalesce(F.col("_rec.message"), F.col("_text_message"), F.lit("")))
        .alias("message"),
        F.col("format"),
        F.col("parse_error"),
    )
    # The record passes through a generator: a filter on it must not be rewritten down through
    # the steps above, which would repeat all of them in its condition. Filters on the other
    # columns still reach the scan, and fields are not built where nobody reads them.
    step = step.select(*given, fields.alias("fields"), F.inline(F.array(record)))
    return step.select(*given, "ts", "ts_source", "level", "message", "fields", "format", "parse_error")


def _add_text_parts(df: DataFrame) -> DataFrame:
    """Split text lines into timestamp, level and message by the head that matches."""
    line = F.col("_line")
    head = F.coalesce(
        F.when(line.startswith("["), F.nullif(F.regexp_extract(line, f"({BRACKETED_HEAD})", 1), F.lit(""))),
        F.when(line.rlike(r"^\d"), F.nullif(F.regexp_extract(line, f"({SPACED_HEAD})", 1), F.lit(""))),
    )
    out = df.withColumn("_head", F.when(F.col("format") == "text", head))
    rest = F.substr(line, F.length("_head") + 1)
    # The message part of a pattern stops at a line feed, so one in it means no match.
    out = out.withColumn("_text_dated", F.coalesce(~rest.contains("\n"), F.lit(False)))
    plain = (F.col("format") == "text") & ~F.col("_text_dated")
    out = out.withColumn(
        "_level_head", F.when(plain, F.nullif(F.regexp_extract(line, f"({LEVEL_HEAD})", 1), F.lit("")))
    )
    rest_of_level = F.substr(line, F.length("_level_head") + 1)
    word = F.regexp_extract("_level_head", r"^(\w+)", 1)
    out = out.withColumn(
        "_level_only",
        F.coalesce(F.col("_level_head").isNotNull() & ~rest_of_level.contains("\n") & is_valid_level(word), F.lit(False)),
    )
    bracketed = F.col("_head").startswith("[")
    stamp = F.when(bracketed, F.regexp_extract("_head", r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract("_head", rf"^({_DAY_CLOCK}{NSP}*)", 1)
    )
    return out.withColumns({
        "_text_ts": F.when(F.col("_text_dated"), stamp),
        "_text_level": F.when(F.col("_text_dated"), F.regexp_extract("_head", rf"(\w+):?{SP}*\z", 1))
        .when(F.col("_level_only"), word),
        "_text_message": F.when(F.col("_text_dated"), trim_space(rest))
        .when(F.col("_level_only"), trim_space(rest_of_level))
        .when(F.col("format") == "text", line),
    })


def _add_record_parts(df: DataFrame, assume_year: int | None) -> DataFrame:
    """Pick timestamp, level and message out of a decoded record; the rest stays in ``fields``."""
    is_json, is_pairs = F.col("format") == "json", F.col("format") == "logfmt"
    json, pairs = F.col("_json"), F.col("_pairs")

    def either(pick) -> Column:
        return F.when(is_json, pick(json)).when(is_pairs, pick(pairs))

    out = df.withColumns({
        "_ts_key": either(lambda record: _first_present(record, TIMESTAMP_KEYS)),
        "_level_key": either(lambda record: _first_present(record, LEVEL_KEYS)),
        "_message_key": either(lambda record: _first_present(record, MESSAGE_KEYS)),
    })
    out = out.withColumn("_ts_value", F.when(is_json, json[F.col("_ts_key")]))
    text = (
        F.when(is_json, F.try_variant_get("_ts_value", "$", "string"))
        .when(is_pairs, pairs[F.col("_ts_key")]).when(F.col("_text_dated"), F.col("_text_ts"))
    )
    out = out.withColumn("_ts_text", tidy_ts(text))
    # No layout is all digits, so text that does not parse may still be a JSON number of seconds.
    out = out.withColumn("_first_ts", parse_tidy_ts(F.col("_ts_text"), assume_year))
    first = F.struct(F.col("_ts_key").alias("key"), F.col("_first_ts").alias("ts"))
    out = out.withColumn(
        "_won", F.when(F.col("_first_ts").isNotNull(), first).when(
            F.col("_ts_key").isNotNull(), F.coalesce(
                F.when(is_json, _first_parsing(json, lambda v: let(v, lambda x: _variant_ts(x, assume_year)))),
                F.when(is_pairs, _first_parsing(pairs, lambda v: parse_ts(v, assume_year))),
            )
        )
    )
    for name in ("level", "message"):
        out = out.withColumn(f"_{name}_value", F.when(is_json, json[F.col(f"_{name}_key")]))
        out = out.withColumn(f"_{name}_scalar", F.try_variant_get(f"_{name}_value", "$", "string"))
        text = F.coalesce(
            F.when(is_pairs, pairs[F.col(f"_{name}_key")]),
            variant_text(F.col(f"_{name}_value"), F.col(f"_{name}_scalar")),
            F.lit("null"),
        )
        out = out.withColumn(f"_{name}_text", F.when(F.col(f"_{name}_key").isNotNull(), text))
    taken = F.array_compact(F.array("_won.key", "_level_key", "_message_key"))
    out = out.withColumn("_taken", taken)
    rest = F.when(is_json, _without(json)).when(is_pairs, _without(pairs).cast(FIELDS_TYPE))
    return out.withColumn(
        "_rec", F.struct(
            F.col("_level_text").alias("level"), F.col("_message_text").alias("message"), rest.alias("fields"),
        )
    )


def parse_json(df: DataFrame, **options) -> DataFrame:
    return parse_logs(df, "json", **options)


def parse_logfmt(df: DataFrame, **options) -> DataFrame:
    return parse_logs(df, "logfmt", **options)


def parse_text(df: DataFrame, **options) -> DataFrame:
    return parse_logs(df, "text", **options)


def parse_auto(df: DataFrame, **options) -> DataFrame:
    return parse_logs(df, "auto", **options)


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that parsed and lines that did not."""
    return parsed.where("parse_error IS NULL"), parsed.where("parse_error IS NOT NULL")
