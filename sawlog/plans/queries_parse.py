"""Sources and parsing."""

from pyspark.sql import functions as F

from sawlog.functions.times import parse_ts
from sawlog.operators.filters import journal_priority
from sawlog.operators.parse import parse_auto, parse_json, parse_logfmt, parse_logs, parse_text, quarantine, reject_reason
from sawlog.plans.catalog import query
from sawlog.plans.views import RAW_LINES_SQL, raw_lines, table
from sawlog.sources.bookmarks import bookmarks, upsert_bookmarks
from sawlog.sources.decode import decode_container_lines, decode_journal_json, label_pod_source
from sawlog.sources.files import lines_from, merge_sources
from sawlog.sources.rules import load_rules

# --- the parsed forms of a raw line, as SQL -----------------------------------------------------

JSON_PARTS_SQL = """
json_parts AS (
  SELECT *, json_valid(body) AND body LIKE '{%' AS is_json FROM (
    SELECT *, CASE WHEN instr(raw, '{') > 0 THEN substr(raw, instr(raw, '{')) ELSE '' END AS body FROM raw_lines))"""

NORMAL_LEVEL = """CASE
    WHEN lower(trim({0})) IN ('debug','info','warn','error','fatal') THEN lower(trim({0}))
    WHEN lower(trim({0})) = 'warning' THEN 'warn' WHEN lower(trim({0})) = 'err' THEN 'error'
    WHEN lower(trim({0})) IN ('crit','critical') THEN 'fatal' WHEN lower(trim({0})) = 'trace' THEN 'debug'
    ELSE 'info' END"""

# The line patterns as the formats define them.
BRACKETED = r"^\[(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}[^]]*)]\s*(\w+):?\s*(.*)$"
SPACED = r"^(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}\S*)\s+(\w+)\s+(.*)$"
LEVEL_ONLY = r"^(\w+):?\s+(.*)$"
LEVEL_NAMES = "('debug','info','warn','error','fatal','warning','err','crit','critical','trace','information')"

TEXT_PARTS_SQL = f"""
text_parts AS (
  SELECT *,
    CASE WHEN is_br THEN regexp_extract(raw, '{BRACKETED}', 1)
         WHEN is_sp THEN regexp_extract(raw, '{SPACED}', 1) END AS text_ts,
    CASE WHEN is_br THEN regexp_extract(raw, '{BRACKETED}', 2)
         WHEN is_sp THEN regexp_extract(raw, '{SPACED}', 2)
         WHEN is_lv THEN regexp_extract(raw, '{LEVEL_ONLY}', 1) ELSE 'info' END AS text_level,
    trim(CASE WHEN is_br THEN regexp_extract(raw, '{BRACKETED}', 3)
         WHEN is_sp THEN regexp_extract(raw, '{SPACED}', 3)
         WHEN is_lv THEN regexp_extract(raw, '{LEVEL_ONLY}', 2) ELSE raw END) AS text_message
  FROM (SELECT *, regexp_matches(raw, '{BRACKETED}') AS is_br, regexp_matches(raw, '{SPACED}') AS is_sp,
      regexp_matches(raw, '{LEVEL_ONLY}')
        AND lower(regexp_extract(raw, '{LEVEL_ONLY}', 1)) IN {LEVEL_NAMES} AS is_lv
    FROM raw_lines))"""

# The pair pattern of logfmt, by group.
PAIR_KEYS = r"""regexp_extract_all(raw, '(\w+)=(?:"([^"]*)"|(\S*))', 1)"""
PAIR_Q = r"""regexp_extract_all(raw, '(\w+)=(?:"([^"]*)"|(\S*))', 2)"""
PAIR_P = r"""regexp_extract_all(raw, '(\w+)=(?:"([^"]*)"|(\S*))', 3)"""
PAIRS_SQL = f"""
pairs AS (
  SELECT line_id, unnest({PAIR_KEYS}) AS k,
    unnest(list_transform(list_zip({PAIR_Q}, {PAIR_P}), lambda x: CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END)) AS v
  FROM raw_lines),
pair_parts AS (
  SELECT line_id, count(*) AS n_pairs, max(v) FILTER (k = 'time') AS p_time, max(v) FILTER (k = 'level') AS p_level,
    max(v) FILTER (k = 'msg') AS p_msg, max(v) FILTER (k = 'user') AS p_user
  FROM pairs GROUP BY line_id)"""


@query("p1_parse_json", f"""
SELECT line_id,
  CASE WHEN is_json THEN (json_extract_string(body, '$.timestamp'))::TIMESTAMP ELSE ingest_ts END AS ts,
  CASE WHEN is_json THEN {NORMAL_LEVEL.format("json_extract_string(body, '$.level')")} ELSE 'info' END AS level,
  CASE WHEN is_json THEN json_extract_string(body, '$.message') ELSE raw END AS message,
  (json_extract(body, '$.user'))::BIGINT AS user_id, (json_extract(body, '$.props.k'))::BIGINT AS props_k,
  CASE WHEN is_json THEN 2 ELSE 0 END AS n_fields,
  CASE WHEN NOT is_json THEN 'invalid_format' END AS parse_error
FROM (SELECT * REPLACE (CASE WHEN is_json THEN body END AS body) FROM json_parts)""", RAW_LINES_SQL, JSON_PARTS_SQL)
def p1_parse_json(spark, sf_dir):
    f = F.col("fields")
    return parse_json(raw_lines(spark, sf_dir)).select(
        "line_id", "ts", "level", "message",
        F.try_variant_get(f["user"], "$", "bigint").alias("user_id"),
        F.try_variant_get(f["props"], "$.k", "bigint").alias("props_k"),
        F.size("fields").alias("n_fields"), "parse_error",
    )


@query("p2_parse_logfmt", f"""
SELECT r.line_id, coalesce(p_time::TIMESTAMP, ingest_ts) AS ts, {NORMAL_LEVEL.format("coalesce(p_level, 'info')")} AS level,
  coalesce(p_msg, '') AS message, p_user AS user_text,
  (CASE WHEN p_user IS NULL THEN 0 ELSE 1 END) AS n_fields
FROM raw_lines r LEFT JOIN pair_parts p ON r.line_id = p.line_id""", RAW_LINES_SQL, PAIRS_SQL)
def p2_parse_logfmt(spark, sf_dir):
    return parse_logfmt(raw_lines(spark, sf_dir)).select(
        "line_id", "ts", "level", "message",
        F.try_variant_get(F.col("fields")["user"], "$", "string").alias("user_text"), F.size("fields").alias("n_fields"),
    )


@query("p3_parse_text", f"""
SELECT line_id, coalesce(text_ts::TIMESTAMP, ingest_ts) AS ts,
  {NORMAL_LEVEL.format("text_level")} AS level, text_message AS message,
  CASE WHEN text_ts IS NULL THEN 'ingest' ELSE 'body' END AS ts_source
FROM text_parts""", RAW_LINES_SQL, TEXT_PARTS_SQL)
def p3_parse_text(spark, sf_dir):
    return parse_text(raw_lines(spark, sf_dir)).select("line_id", "ts", "level", "message", "ts_source")


AUTO_SQL = f"""
auto_parts AS (
  SELECT j.line_id, j.source, j.raw, j.ingest_ts,
    CASE WHEN is_json THEN 'json' WHEN coalesce(n_pairs, 0) >= 2 THEN 'logfmt' ELSE 'text' END AS format,
    CASE WHEN is_json THEN json_extract_string(body, '$.timestamp')
      WHEN coalesce(n_pairs, 0) >= 2 THEN p_time ELSE text_ts END AS ts_text,
    CASE WHEN is_json THEN json_extract_string(body, '$.level')
      WHEN coalesce(n_pairs, 0) >= 2 THEN p_level ELSE text_level END AS level_text,
    CASE WHEN is_json THEN json_extract_string(body, '$.message')
      WHEN coalesce(n_pairs, 0) >= 2 THEN p_msg ELSE text_message END AS message
  FROM (SELECT * REPLACE (CASE WHEN is_json THEN body END AS body) FROM json_parts) j
  JOIN text_parts t ON j.line_id = t.line_id LEFT JOIN pair_parts p ON j.line_id = p.line_id),
auto_lines AS (
  SELECT line_id, source, coalesce(ts_text::TIMESTAMP, ingest_ts) AS ts, {NORMAL_LEVEL.format("level_text")} AS level,
    message, format FROM auto_parts)"""
AUTO_VIEWS = (RAW_LINES_SQL, JSON_PARTS_SQL, TEXT_PARTS_SQL, PAIRS_SQL, AUTO_SQL)


@query("p4_parse_auto", "SELECT line_id, source, ts, level, message, format FROM auto_lines", *AUTO_VIEWS)
def p4_parse_auto(spark, sf_dir):
    return parse_auto(raw_lines(spark, sf_dir)).select("line_id", "source", "ts", "level", "message", "format")


@query("p5_parse_logs", f"""
SELECT line_id, parser,
  CASE parser WHEN 'json' THEN CASE WHEN is_json THEN 'json' END WHEN 'logfmt' THEN 'logfmt' WHEN 'text' THEN 'text'
    ELSE format END AS format,
  CASE parser WHEN 'json' THEN CASE WHEN is_json THEN message ELSE raw END
    WHEN 'logfmt' THEN coalesce(p_msg, '') WHEN 'text' THEN text_message ELSE message END AS message
FROM (SELECT a.*, is_json, p_msg, text_message,
    CASE a.source WHEN 'svc-0' THEN 'json' WHEN 'svc-1' THEN 'logfmt' WHEN 'svc-2' THEN 'text' ELSE 'auto' END AS parser
  FROM auto_parts a JOIN json_parts j USING (line_id) JOIN text_parts t USING (line_id)
  LEFT JOIN pair_parts p USING (line_id))""", *AUTO_VIEWS)
def p5_parse_logs(spark, sf_dir):
    parser = (
        F.when(F.col("source") == "svc-0", "json").when(F.col("source") == "svc-1", "logfmt")
        .when(F.col("source") == "svc-2", "text").otherwise("auto")
    )
    lines = raw_lines(spark, sf_dir).withColumn("parser", parser)
    return parse_logs(lines, F.col("parser")).select("line_id", "parser", "format", "message")


@query("p6_fallback", """
SELECT source, is_json AS parsed, count(*) AS lines, count(*) FILTER (NOT is_json) AS kept_raw
FROM json_parts GROUP BY source, is_json""", RAW_LINES_SQL, JSON_PARTS_SQL)
def p6_fallback(spark, sf_dir):
    good, bad = quarantine(parse_json(raw_lines(spark, sf_dir)))
    both = good.withColumn("parsed", F.lit(True)).unionByName(bad.withColumn("parsed", F.lit(False)))
    same = F.col("message") == F.col("raw")
    return both.groupBy("source", "parsed").agg(
        F.count("*").alias("lines"), F.count_if(~F.col("parsed") & same).alias("kept_raw")
    )


@query("p7_reject_reasons", r"""
SELECT doc_id, CASE WHEN regexp_replace(text, '^[\s\x0b\x{85}\x{a0}]+', '') = '' THEN 'empty'
  WHEN strlen(trim(text, E' \t\n\r')) > 262144 THEN 'too_large' END AS reason
FROM (SELECT doc_id, CASE doc_id % 50 WHEN 1 THEN E' \t' WHEN 2 THEN repeat(text, 1 + 262144 // strlen(text)) ELSE text END AS text FROM documents)""")
def p7_reject_reasons(spark, sf_dir):
    many = F.repeat("text", 1 + F.floor(F.lit(262144) / F.octet_length("text")).cast("int"))
    text = F.when(F.col("doc_id") % 50 == 1, F.lit(" \t")).when(F.col("doc_id") % 50 == 2, many).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", reject_reason(text).alias("reason"))


@query("p8_timestamp_pick", """
SELECT event_id AS line_id, date_trunc('second', ts) AS ts,
  CASE event_id % 3 WHEN 0 THEN '{"time":"soon"}' WHEN 1 THEN '{}' ELSE '{"ts":"2020-01-01T00:00:00Z"}' END AS rest
FROM events""")
def p8_timestamp_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = F.floor(F.unix_micros("ts") / 1_000_000).cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"time":"soon","ts":'), seconds, F.lit("}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"@timestamp":"'), iso, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"ts":"2020-01-01T00:00:00Z","timestamp":'), seconds, F.lit(".9}")))
    )
    lines = e.select(F.col("event_id").alias("line_id"), raw.alias("raw"))
    return parse_json(lines).select("line_id", "ts", F.to_json("fields").alias("rest"))


@query("p9_level_pick", """
SELECT event_id AS line_id, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'fatal' WHEN 2 THEN 'info' ELSE 'warn' END AS level
FROM events""")
def p9_level_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bodies = ['{"level":null,"lvl":"error"}', '{"severity":"CRIT","loglevel":"debug"}', '{"msg":"none"}', '{"lvl":" Warning "}']
    raw = F.element_at(F.array(*map(F.lit, bodies)), (F.col("event_id") % 4 + 1).cast("int"))
    return parse_json(e.select(F.col("event_id").alias("line_id"), raw.alias("raw"))).select("line_id", "level")


@query("p10_message_pick", """
SELECT event_id AS line_id, CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN 'first' WHEN 2 THEN ''
  WHEN 3 THEN 'null' ELSE '{"k":' || json_extract(props, '$.k') || '}' END AS message
FROM events""")
def p10_message_pick(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    raw = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"log":'), user, F.lit("}")))
        .when(F.col("event_id") % 5 == 1, F.lit('{"text":"second","msg":"first"}'))
        .when(F.col("event_id") % 5 == 2, F.lit('{"level":"warn"}'))
        .when(F.col("event_id") % 5 == 3, F.lit('{"message":null}'))
        .otherwise(F.concat(F.lit('{"message":'), "props", F.lit("}")))
    )
    return parse_json(e.select(F.col("event_id").alias("line_id"), raw.alias("raw"))).select("line_id", "message")


@query("p11_parse_ts", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts)
  WHEN 3 THEN date_trunc('millisecond', ts) WHEN 4 THEN date_trunc('second', ts) - INTERVAL 1 HOUR
  WHEN 5 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE END AS ts
FROM events""")
def p11_parse_ts(spark, sf_dir):
    layouts = [
        "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss,SSS",
        "dd/MMM/yyyy:HH:mm:ss '+0100'", "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "yyyy-MM-dd", "MMM dd HH:mm:ss",
    ]
    text = F
    for i, layout in enumerate(layouts):
        text = text.when(F.col("event_id") % len(layouts) == i, F.date_format("ts", layout))
    return table(spark, sf_dir, "events").select("event_id", parse_ts(text).alias("ts"))


# --- sources ------------------------------------------------------------------------------------

READS_SQL = """
reads AS (
  SELECT '/var/log/app-' || (user_id % 20) || '.log' AS file, event_id * 100 AS "offset", user_id % 3 AS inode, ts AS saved_at
  FROM events)"""


def _reads(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/var/log/app-"), F.col("user_id") % 20, F.lit(".log")).alias("file"),
        (F.col("event_id") * 100).alias("offset"), (F.col("user_id") % 3).alias("inode"), F.col("ts").alias("saved_at"),
    )


@query("s4_bookmarks", """
SELECT file, "offset", inode, saved_at FROM (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY saved_at DESC) AS rn FROM reads) WHERE rn = 1""", READS_SQL)
def s4_bookmarks(spark, sf_dir):
    return bookmarks(_reads(spark, sf_dir))


@query("s4_upsert_bookmarks", """
SELECT name, file, "offset", inode, saved_at FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY saved_at DESC) AS rn FROM (
    SELECT 'mark-' || (inode * 7 + "offset" // 100 % 7) AS name, * FROM reads)) WHERE rn = 1""", READS_SQL)
def s4_upsert_bookmarks(spark, sf_dir):
    named = _reads(spark, sf_dir).withColumn(
        "name", F.concat(F.lit("mark-"), F.col("inode") * 7 + F.expr("`offset` div 100 % 7"))
    )
    first = F.col("inode") == 0
    return upsert_bookmarks(named.where(first), named.where(~first)).select("name", "file", "offset", "inode", "saved_at")


@query("s5_decode_container_lines", """
SELECT event_id AS line_id, 'docker:' || event_type AS source,
  CASE WHEN event_id % 3 < 2 THEN ts END AS env_ts,
  CASE WHEN event_id % 3 < 2 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' END || 'user ' || user_id || ' done' AS raw
FROM events""")
def s5_decode_container_lines(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    wide = F.when(F.col("event_id") % 3 < 2, F.concat(stamp, F.lit("000Z"))).otherwise(F.concat(stamp, F.lit("Z")))
    body = F.concat(F.lit(" \x1b[31muser "), F.col("user_id").cast("string"), F.lit("\x1b[0m done  "))
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"), F.col("event_type").alias("container"), F.concat(wide, body).alias("raw")
    )
    return decode_container_lines(lines).select("line_id", "source", "env_ts", "raw")


def _journal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entry = F.concat(
        F.lit('{"MESSAGE":"'), "event_type", F.lit('","__REALTIME_TIMESTAMP":"'), F.unix_micros("ts").cast("string"),
        F.lit('","PRIORITY":"'), (F.col("user_id") % 9).cast("string"), F.lit('","_PID":"'), F.col("user_id").cast("string"),
        F.lit('","_BOOT_ID":"x","_COMM":7}'),
    )
    odd = F.when(F.col("event_id") % 5 == 0, F.lit("-- Reboot --")).when(
        F.col("event_id") % 5 == 1, F.lit('{"MESSAGE":[1,2],"PRIORITY":3}')
    ).otherwise(entry)
    return decode_journal_json(e.select(F.col("event_id").alias("line_id"), odd.alias("raw")), unit="app.service")


@query("s6_decode_journal_json", """
SELECT event_id AS line_id, 'journalctl:app.service' AS source,
  CASE event_id % 5 WHEN 0 THEN '-- Reboot --' WHEN 1 THEN '' ELSE event_type END AS raw,
  CASE WHEN event_id % 5 > 1 THEN ts END AS env_ts,
  CASE WHEN event_id % 5 < 2 THEN 'info' ELSE CASE user_id % 9 WHEN 0 THEN 'fatal' WHEN 1 THEN 'fatal' WHEN 2 THEN 'fatal'
    WHEN 3 THEN 'error' WHEN 4 THEN 'warn' WHEN 7 THEN 'debug' ELSE 'info' END END AS env_level,
  CASE WHEN event_id % 5 > 1 THEN user_id::VARCHAR END AS pid,
  CASE WHEN event_id % 5 > 1 THEN 2 ELSE 0 END AS n_fields
FROM events""")
def s6_decode_journal_json(spark, sf_dir):
    return _journal(spark, sf_dir).select(
        "line_id", "source", "raw", "env_ts", "env_level",
        F.try_variant_get(F.col("env_fields")["_pid"], "$", "string").alias("pid"), F.size("env_fields").alias("n_fields"),
    )


@query("s7_journal_priority", """
SELECT event_id AS line_id, user_id % 9 AS priority FROM events WHERE event_id % 5 > 1 AND user_id % 9 <= 4""")
def s7_journal_priority(spark, sf_dir):
    kept = journal_priority(_journal(spark, sf_dir), "warning")
    return kept.select("line_id", F.col("priority").cast("bigint").alias("priority"))


@query("s8_label_pod_source", """
SELECT event_id AS line_id, CASE event_id % 4
  WHEN 0 THEN 'k8s:prod/' || event_type || '-' || user_id WHEN 1 THEN 'k8s:selector=app=' || event_type
  WHEN 2 THEN 'k8s:' || event_type || '-' || user_id END AS source
FROM events""")
def s8_label_pod_source(spark, sf_dir):
    which = F.col("event_id") % 4
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"),
        F.when(which == 0, "prod").otherwise("").alias("namespace"),
        F.when(which != 1, F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))).alias("pod"),
        F.when(which.isin(1, 3), F.concat(F.lit("app="), "event_type")).alias("selector"),
    )
    return label_pod_source(lines).select("line_id", "source")


@query("s9_lines_from", """
SELECT conv_id, turn, 'chat:' || role AS source, strlen(text) AS bytes, text AS raw FROM conversations WHERE text <> ''""")
def s9_lines_from(spark, sf_dir):
    chat = table(spark, sf_dir, "conversations")
    lines = lines_from(chat, "text", F.concat(F.lit("chat:"), "role"))
    return lines.select("conv_id", "turn", "source", F.octet_length("raw").cast("bigint").alias("bytes"), "raw")


@query("s10_merge_sources", """
SELECT source, count(*) AS lines, sum(length(raw))::BIGINT AS chars FROM (
  SELECT source, raw FROM raw_lines UNION ALL SELECT 'documents', text FROM documents WHERE text <> ''
  UNION ALL SELECT 'pages', html FROM pages WHERE html <> '') GROUP BY source""", RAW_LINES_SQL)
def s10_merge_sources(spark, sf_dir):
    merged = merge_sources(
        raw_lines(spark, sf_dir),
        lines_from(table(spark, sf_dir, "documents"), "text", "documents"),
        lines_from(table(spark, sf_dir, "pages"), "html", "pages"),
    )
    return merged.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("raw")).alias("chars"))


@query("s12_load_rules", """
SELECT 'rule-' || event_id AS name, 'warning' AS severity,
  CASE event_id % 5 WHEN 0 THEN (user_id * 60 + 30) * 1000000 WHEN 1 THEN user_id * 1500000
    WHEN 2 THEN 300000000 WHEN 3 THEN 300000000 ELSE user_id * 3600000000 + 250 END AS cooldown_us,
  0 AS window_us
FROM events WHERE event_type <> 'view'""")
def s12_load_rules(spark, sf_dir):
    n = F.col("user_id").cast("string")
    text = F
    for i, parts in enumerate([
        [n, F.lit("m30s")], [(F.col("user_id") * 1.5).cast("string"), F.lit("s")], [F.lit("")], [n, F.lit(" minutes")],
        [n, F.lit("h250us")],
    ]):
        text = text.when(F.col("event_id") % 5 == i, F.concat(*parts))
    settings = table(spark, sf_dir, "events").select(
        F.concat(F.lit("rule-"), F.col("event_id").cast("string")).alias("name"), F.lit("level").alias("type"),
        F.lit("WARNING").alias("severity"), F.lit("error").alias("level"), text.alias("cooldown"),
        (F.col("event_type") != "view").alias("enabled"),
    )
    return load_rules(settings).select("name", "severity", "cooldown_us", "window_us")


