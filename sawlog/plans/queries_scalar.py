"""Scalar functions over whole table columns."""

from pyspark.sql import functions as F

from sawlog.functions.jsonfmt import log_json, mask_secrets
from sawlog.functions.levels import is_valid_level, level_rank, normalize_level
from sawlog.functions.text import (
    derive_source_name, format_line, is_safe_name, resolve_index, sanitize_label, sanitize_text, strip_ansi,
)
from sawlog.functions.times import format_duration, full_duration, parse_duration, relative_time
from sawlog.functions.urls import is_external_url
from sawlog.operators.collapse import repeat_key
from sawlog.plans.catalog import query
from sawlog.plans.views import LOG_LINES_SQL, log_lines, table

SPELLINGS = ["DEBUG", " Info ", "warn", "Warning", "err", "ERROR", "crit", "Critical", "fatal", "trace", "information", "odd"]
SPELLED_SQL = f"SELECT event_id, {SPELLINGS!r}[1 + event_id % {len(SPELLINGS)}] AS spelled FROM events"


def _spelled(spark, sf_dir):
    names = F.array(*map(F.lit, SPELLINGS))
    return table(spark, sf_dir, "events").select(
        "event_id", F.element_at(names, (F.col("event_id") % len(SPELLINGS) + 1).cast("int")).alias("spelled")
    )


@query("o1_normalize_level", f"""
SELECT event_id, CASE lower(trim(spelled)) WHEN 'warning' THEN 'warn' WHEN 'err' THEN 'error' WHEN 'crit' THEN 'fatal'
  WHEN 'critical' THEN 'fatal' WHEN 'trace' THEN 'debug' WHEN 'information' THEN 'info' WHEN 'odd' THEN 'info'
  ELSE lower(trim(spelled)) END AS level FROM ({SPELLED_SQL})""")
def o1_normalize_level(spark, sf_dir):
    return _spelled(spark, sf_dir).select("event_id", normalize_level(F.col("spelled")).alias("level"))


@query("o2_is_valid_level", f"SELECT event_id, spelled <> 'odd' AS valid FROM ({SPELLED_SQL})")
def o2_is_valid_level(spark, sf_dir):
    return _spelled(spark, sf_dir).select("event_id", is_valid_level(F.col("spelled")).alias("valid"))


@query("o3_level_rank", f"""
SELECT event_id, CASE lower(spelled) WHEN 'debug' THEN 0 WHEN 'warn' THEN 2 WHEN 'error' THEN 3 WHEN 'fatal' THEN 4 END AS rank
FROM ({SPELLED_SQL})""")
def o3_level_rank(spark, sf_dir):
    return _spelled(spark, sf_dir).select("event_id", level_rank(F.col("spelled")).alias("rank"))


@query("o4_format_line", """
SELECT conv_id, turn, '[2024-01-15 10:30:00] [' || role || '] INFO: ' || text AS line FROM conversations""")
def o4_format_line(spark, sf_dir):
    at = F.lit("2024-01-15 10:30:00").cast("timestamp")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", format_line(at, F.col("role"), F.lit("info"), F.col("text")).alias("line")
    )


@query("o6_strip_ansi", "SELECT event_id, event_type || ' ' || user_id || '[x' AS text FROM events")
def o6_strip_ansi(spark, sf_dir):
    coloured = F.concat(
        F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m \x1b[K"), F.col("user_id").cast("string"), F.lit("\x1b[2J[x")
    )
    return table(spark, sf_dir, "events").select("event_id", strip_ansi(coloured).alias("text"))


@query("o6_strip_ansi_documents", r"""
SELECT doc_id, md5(regexp_replace(replace(text, 'a', chr(27) || '[1;31ma' || chr(27) || '[0m'), '\x1b\[[0-9;]*[a-zA-Z]', '', 'g')) AS digest FROM documents""")
def o6_strip_ansi_documents(spark, sf_dir):
    coloured = F.replace("text", F.lit("a"), F.lit("\x1b[1;31ma\x1b[0m"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strip_ansi(coloured)).alias("digest"))


_MICROS_SQL = "SELECT event_id, epoch_us(ts) % CASE event_id % 4 WHEN 0 THEN 1000000 WHEN 1 THEN 60000000 WHEN 2 THEN 3600000000 ELSE 864000000000 END AS us FROM events"


def _spans(spark, sf_dir):
    limits = F.array(*[F.lit(n).cast("bigint") for n in (1_000_000, 60_000_000, 3_600_000_000, 864_000_000_000)])
    limit = F.element_at(limits, (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", (F.unix_micros("ts") % limit).alias("us"))


@query("o7_format_duration", f"""
SELECT event_id, CASE WHEN us < 1000000 THEN (us // 1000) || 'ms' WHEN us < 60000000 THEN (us // 1000000) || 's'
  WHEN us // 1000000 % 60 = 0 THEN (us // 60000000) || 'm' ELSE (us // 60000000) || 'm' || (us // 1000000 % 60) || 's' END AS text
FROM ({_MICROS_SQL})""")
def o7_format_duration(spark, sf_dir):
    return _spans(spark, sf_dir).select("event_id", format_duration(F.col("us")).alias("text"))


@query("o8_dedup_key", """
SELECT line_id, unhex(sha256(strlen(source) || ':' || source || strlen(level) || ':' || level || strlen(message) || ':' || message)) AS key
FROM log_lines""".replace("unhex(", "upper(") , LOG_LINES_SQL)
def o8_dedup_key(spark, sf_dir):
    return log_lines(spark, sf_dir).select("line_id", F.hex(repeat_key()).alias("key"))


@query("o9_sanitize_label", r"""
SELECT page_id, CASE WHEN regexp_full_match(substr(trim(url), 1, 40), '[a-zA-Z0-9/_.:@-]+') THEN substr(trim(url), 1, 40)
  ELSE 'unknown' END AS label FROM pages""")
def o9_sanitize_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sanitize_label(F.col("url"), 40).alias("label"))


@query("o10_sanitize_text", r"""
SELECT page_id, regexp_replace(substr(trim(replace(url, '/', chr(9)), E' \t\n\r'), 1, 24), '[\x00-\x1f\x7f]', '', 'g') AS text
FROM pages""")
def o10_sanitize_text(spark, sf_dir):
    tabbed = F.replace(F.col("url"), F.lit("/"), F.lit("\t"))
    return table(spark, sf_dir, "pages").select("page_id", sanitize_text(tabbed, 24).alias("text"))


@query("o12_parse_duration", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id * 3600000000 + 90000000 WHEN 1 THEN user_id * 1500 WHEN 2 THEN -user_id * 1000000
  WHEN 3 THEN user_id END AS us FROM events""")
def o12_parse_duration(spark, sf_dir):
    n = F.col("user_id").cast("string")
    text = F
    for i, parts in enumerate([
        [n, F.lit("h1m30s")], [n, F.lit("ms"), n, F.lit("000.500us"), n, F.lit("us")], [F.lit("-"), n, F.lit("s")],
        [n, F.lit("000ns")], [n, F.lit("d")],
    ]):
        text = text.when(F.col("event_id") % 5 == i, F.concat(*parts))
    spans = table(spark, sf_dir, "events").withColumn("text", text)
    us = parse_duration(F.col("text"))
    # 'Nms' + 'N000.5us' + 'Nus' is N * 2001 whole microseconds and a half that is cut.
    return spans.select("event_id", F.when(F.col("event_id") % 5 == 1, us - F.col("user_id") * 501).otherwise(us).alias("us"))


@query("o13_full_duration", f"""
SELECT event_id, CASE WHEN us = 0 THEN '0s' WHEN us < 1000 THEN us || 'µs'
  WHEN us < 1000000 THEN (us // 1000) || rtrim(rtrim('.' || lpad((us % 1000)::VARCHAR, 3, '0'), '0'), '.') || 'ms'
  ELSE CASE WHEN us >= 3600000000 THEN (us // 3600000000) || 'h' ELSE '' END
    || CASE WHEN us >= 60000000 THEN (us // 60000000 % 60) || 'm' ELSE '' END
    || (us // 1000000 % 60) || rtrim(rtrim('.' || lpad((us % 1000000)::VARCHAR, 6, '0'), '0'), '.') || 's' END AS text
FROM ({_MICROS_SQL})""")
def o13_full_duration(spark, sf_dir):
    return _spans(spark, sf_dir).select("event_id", full_duration(F.col("us")).alias("text"))


@query("o14_resolve_index", """
SELECT event_id, 'app-' || strftime(ts, '%Y.%m.%d') || '-' || strftime(ts, '%Y.%m') || '-' || strftime(ts, '%Y') AS name FROM events""")
def o14_resolve_index(spark, sf_dir):
    name = resolve_index("app-%{+YYYY.MM.dd}-%{+YYYY.MM}-%{+YYYY}", F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", name.alias("name"))


@query("o15_mask_secrets", """
SELECT event_id, CASE event_id % 3
  WHEN 0 THEN '{"list":[{"token":"t"}],"nested":{"API_KEY":"****","n":' || user_id || '},"user_password":"****"}'
  WHEN 1 THEN '{"secret":"","token":' || user_id || '}' ELSE '{"n":1.5,"url":"\\u003c' || event_type || '\\u003e\\u0026"}' END AS config FROM events""")
def o15_mask_secrets(spark, sf_dir):
    n = F.col("user_id").cast("string")
    config = (
        F.when(F.col("event_id") % 3 == 0, F.concat(
            F.lit('{"user_password":"'), n, F.lit('","nested":{"n":'), n, F.lit(',"API_KEY":"k"},"list":[{"token":"t"}]}')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"secret":"","token":'), n, F.lit("}")))
        .otherwise(F.concat(F.lit('{"url": "<'), "event_type", F.lit('>&" , "n":1.50}')))
    )
    return table(spark, sf_dir, "events").select("event_id", mask_secrets(config).alias("config"))


@query("o16_derive_source_name", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'nginx-' || event_type || '-' || user_id WHEN 1 THEN event_type
  ELSE 'my-app-a-b.' || user_id END AS name FROM events""")
def o16_derive_source_name(spark, sf_dir):
    n = F.col("user_id").cast("string")
    path = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/var/log/nginx/"), "event_type", F.lit(" "), n, F.lit(".log")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("/var/log/"), "event_type", F.lit(".log")))
        .otherwise(F.concat(F.lit("/srv/my app/a&b."), n, F.lit(".log")))
    )
    return table(spark, sf_dir, "events").select("event_id", derive_source_name(path).alias("name"))


@query("o17_is_safe_name", r"""
SELECT page_id, regexp_full_match(url, '[a-zA-Z0-9][a-zA-Z0-9._:@-]*') AS url_safe,
  regexp_full_match(regexp_extract(url, '//([^/?#]*)', 1), '[a-zA-Z0-9][a-zA-Z0-9._:@-]*') AS host_safe FROM pages""")
def o17_is_safe_name(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", is_safe_name(F.col("url")).alias("url_safe"), is_safe_name(host).alias("host_safe")
    )


@query("o20_relative_time", """
SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago'
  ELSE (s // 86400) || 'd ago' END AS text
FROM (SELECT event_id, (epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) // 1000 AS s FROM events)""")
def o20_relative_time(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", relative_time(F.col("ts"), now).alias("text"))


@query("o21_to_ndjson", """
SELECT conv_id, turn, '{"timestamp":"2024-01-15T10:30:00.5Z","level":"info","message":'
  || replace(replace(replace(to_json('<"' || text || '">')::VARCHAR, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')
  || ',"source":"' || role || '","fields":{"conv":' || conv_id || ',"turn":"' || turn || '"}}' AS line FROM conversations""")
def o21_to_ndjson(spark, sf_dir):
    at = F.lit("2024-01-15 10:30:00.5").cast("timestamp")
    fields = F.create_map(F.lit("turn"), F.col("turn").cast("string").cast("variant"), F.lit("conv"), F.col("conv_id").cast("variant"))
    message = F.concat(F.lit('<"'), "text", F.lit('">'))
    line = log_json(at, F.lit("info"), message, F.col("role"), fields)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))


@query("o22_is_external_url", r"""
SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AND NOT regexp_matches(url, '^https?://(localhost|metadata.google.internal)([:/?#]|$)')
  AS external, page_id % 5 IN (3, 4) AS variant_external
FROM pages""")
def o22_is_external_url(spark, sf_dir):
    hosts = ["127.0.0.1", "10.1.2.3:8080", "[fe80::1]", "8.8.8.8", "[2001:db8::1]:443"]
    host = F.element_at(F.array(*map(F.lit, hosts)), (F.col("page_id") % 5 + 1).cast("int"))
    other = F.concat(F.lit("http://"), host, F.lit("/x"))
    return table(spark, sf_dir, "pages").select(
        "page_id", is_external_url(F.col("url")).alias("external"), is_external_url(other).alias("variant_external")
    )
