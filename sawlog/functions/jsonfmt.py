"""JSON text: value rendering, records, masking."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from sawlog.functions.binding import let

# Key parts whose string values are masked.
SENSITIVE = ["password", "token", "secret", "api_key", "apikey"]
MASK = "****"


def escape_html(text: Column) -> Column:
    """Write ``< > &`` and the two line separators as escapes, as in a JSON body safe for HTML."""
    for char, code in [("&", "0026"), ("<", "003c"), (">", "003e"), ("\u2028", "2028"), ("\u2029", "2029")]:
        text = F.replace(text, F.lit(char), F.lit("\\u" + code))
    return text


def json_string(text: Column) -> Column:
    """The text as a JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("s")), {"ignoreNullFields": "false"})
    return escape_html(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def rfc3339(ts: Column, fraction: bool = True) -> Column:
    """UTC timestamp text; the fraction has no trailing zeros and vanishes when it is zero."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    if not fraction:
        return F.concat(seconds, F.lit("Z"))
    digits = F.rtrim(F.date_format(ts, ".SSSSSS"), F.lit("0"))
    return F.concat(seconds, F.when(digits == ".", F.lit("")).otherwise(digits), F.lit("Z"))


def float_text(value: Column, low: int = -4, high: int = 6, pad: int = 2) -> Column:
    """Shortest decimal text of a double; exponent form (``1e+06``) below ``low`` and from ``high`` on."""

    def digits(text: Column) -> Column:
        plain = F.regexp_extract(text, r"^([0-9.]+)", 1)
        power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)\z", 1).try_cast("int"), F.lit(0))
        return F.struct(plain.alias("plain"), F.replace(plain, F.lit("."), F.lit("")).alias("all"), power.alias("power"))

    def scale(d: Column) -> Column:
        unled = F.ltrim(d["all"], F.lit("0"))
        lead = F.length(d["all"]) - F.length(unled)
        place = F.instr(d.plain, ".") - 1
        return F.struct(F.rtrim(unled, F.lit("0")).alias("digits"), (place - lead - 1 + d.power).alias("exp"))

    def written(d: Column) -> Column:
        count = F.length(d.digits)
        size = F.abs(d.exp).cast("string")
        scientific = F.concat(
            F.substring(d.digits, 1, 1),
            F.when(count > 1, F.concat(F.lit("."), F.substr(d.digits, F.lit(2)))).otherwise(F.lit("")),
            F.when(d.exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.when(F.length(size) < pad, F.lit("0")).otherwise(F.lit("")), size,
        )
        plain = (
            F.when(d.exp < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -d.exp - 1), d.digits))
            .when(count <= d.exp + 1, F.rpad(d.digits, d.exp + 1, F.lit("0")))
            .otherwise(F.concat(F.substr(d.digits, F.lit(1), d.exp + 1), F.lit("."), F.substr(d.digits, d.exp + 2)))
        )
        return F.when((d.exp < low) | (d.exp >= high), scientific).otherwise(plain)

    body = let(let(let(F.abs(value).cast("string"), digits), scale), written)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(value == 0, F.lit("0")).otherwise(F.concat(sign, body))


def variant_text(value: Column, scalar: Column) -> Column:
    """A JSON value as text: strings as they are, numbers as doubles, the rest as compact JSON.

    ``scalar`` is the value cast to a string, null for JSON null. The type is only looked up for
    text that may not come from a string.
    """
    maybe_other = scalar.rlike(r"^(-?\d[\d.eE+-]*\z|[\[{])")
    kind = F.schema_of_variant(value)
    other = (
        F.when(kind == "STRING", scalar)
        .when(is_number_kind(kind), float_text(F.try_variant_get(value, "$", "double")))
        .otherwise(escape_html(scalar))
    )
    return F.when(scalar.isNull(), F.to_json(value)).when(maybe_other, other).otherwise(scalar)


def is_number_kind(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def _json_value(value: Column) -> Column:
    number = F.when(
        is_number_kind(F.schema_of_variant(value)),
        float_text(F.try_variant_get(value, "$", "double"), low=-6, high=21, pad=1),
    )
    return F.coalesce(number, escape_html(F.to_json(value)), F.lit("null"))


def fields_json(fields: Column) -> Column:
    """A field map as a JSON object with its keys in order."""
    keys = F.array_sort(F.map_keys(fields))
    members = F.transform(keys, lambda k: F.concat(json_string(k), F.lit(":"), _json_value(fields[k])))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def log_json(ts: Column, level: Column, message: Column, source: Column, fields: Column) -> Column:
    """One log record as a JSON object; empty fields are left out."""
    extra = F.when(F.size(fields) > 0, F.concat(F.lit(',"fields":'), fields_json(fields)))
    return F.concat(
        F.lit('{"timestamp":"'), rfc3339(ts), F.lit('","level":'), json_string(level),
        F.lit(',"message":'), json_string(message), F.lit(',"source":'), json_string(source),
        F.coalesce(extra, F.lit("")), F.lit("}"),
    )


def alert_json(
    rule: Column, severity: Column, message: Column, source: Column, fired_at: Column, count: Column
) -> Column:
    """One alert event as a JSON object; an empty source and a zero count are left out."""
    origin = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit(',"source":'), json_string(source)))
    number = F.when(F.coalesce(count, F.lit(0)) != 0, F.concat(F.lit(',"count":'), count.cast("string")))
    return F.concat(
        F.lit('{"rule":'), json_string(rule), F.lit(',"severity":'), json_string(severity),
        F.lit(',"message":'), json_string(message), F.coalesce(origin, F.lit("")),
        F.lit(',"timestamp":"'), rfc3339(fired_at), F.lit('"'), F.coalesce(number, F.lit("")), F.lit("}"),
    )


def _number(value: float) -> str:
    """A number as a double: shortest digits, plain between 1e-6 and 1e21."""
    text = repr(value)
    if value == 0 or 1e-6 <= abs(value) < 1e21:
        return format(Decimal(text), "f").removesuffix(".0")
    return re.sub(r"\.0(?=e)|(?<=e[+-])0+", "", text)


def _encoded(value, hide: bool = False, listed: bool = False) -> str:
    """Compact JSON with sorted keys; strings under keys that sound secret are masked, but not inside lists."""
    if isinstance(value, dict):
        secret = lambda k: not listed and any(part in k.lower() for part in SENSITIVE)
        return "{" + ",".join(f"{_encoded(k)}:{_encoded(v, secret(k), listed)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_encoded(v, listed=True) for v in value) + "]"
    if isinstance(value, float):
        return _number(value)
    text = json.dumps(MASK if hide and isinstance(value, str) and value else value, ensure_ascii=False)
    return text.translate(_HTML) if isinstance(value, str) else text


def _refuse(constant: str):
    raise ValueError(constant)


_HTML = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}


@pandas_udf(T.StringType())
def _mask_json(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            value = json.loads(text, parse_int=float, parse_constant=_refuse)
        except (TypeError, ValueError):
            return text
        return _encoded(value) if isinstance(value, dict) else text
    return texts.map(one)


def mask_secrets(config: Column) -> Column:
    """JSON objects encoded anew: compact, keys sorted, ``<>&`` escaped, non-empty strings under secret-looking keys replaced at any object depth.

    Other texts stay as they are. Objects may nest to any depth, which column functions cannot follow, so
    texts that may be objects go through Arrow batches.
    """
    object_like = config.rlike(r"^[ \t\r\n]*\{")
    return F.when(object_like, _mask_json(F.when(object_like, config))).otherwise(config)
