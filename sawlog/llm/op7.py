"""Query: ``conversations`` in reply order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.quotations import linked


UNITS_SQL = """
  SELECT {keys}, lower(trim(regexp_replace(passage, '\\s+', ' ', 'g'))) AS unit, min(size) AS size FROM (
    SELECT {keys}, 0 AS size, passage FROM {source}
    UNION ALL SELECT {keys}, 1, unnest(regexp_split_to_array(passage, '\\n[ \\t]*\\n')) FROM {source}
    UNION ALL SELECT {keys}, 2, unnest(string_split(passage, chr(10))) FROM {source})
  GROUP BY ALL HAVING length(unit) >= 4"""
SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (
  SELECT row, conv_id, turn, k, line, regexp_extract(line, '^[ \t]*>(?:[ \t]*>)*[ \t]?') AS marks
  FROM (SELECT *, unnest(parts) AS line, generate_subscripts(parts, 1) AS k
        FROM (SELECT *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM m))),
v AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level, line[length(marks) + 1:] AS body FROM l),
n AS (
  SELECT *, lag(level, 1, 0) OVER w AS before, level = 0 AND lead(level, 1, 0) OVER w > 0 AND regexp_matches(line, '^On .{{1,200}} wrote:\s*$') AS credit
  FROM v WINDOW w AS (PARTITION BY row ORDER BY k)),
b AS (SELECT *, sum((level > 0 AND level <> before)::INT) OVER (PARTITION BY row ORDER BY k) AS block FROM n),
own AS (SELECT row, conv_id, turn, string_agg(line, chr(10) ORDER BY k) AS passage FROM b WHERE level = 0 AND NOT credit GROUP BY ALL),
quoted AS (SELECT row, conv_id, turn, block, level, string_agg(body, chr(10) ORDER BY k) AS passage FROM b WHERE level > 0 GROUP BY ALL),
own_units AS ({UNITS_SQL.format(keys="conv_id, turn", source="own")}),
quote_units AS ({UNITS_SQL.format(keys="row, conv_id, turn, block, level", source="quoted")}),
origins AS (SELECT conv_id, unit, min(turn) AS origin FROM own_units GROUP BY ALL),
found AS (
  SELECT row, q.conv_id, turn, block, level, min((size, -origin)) AS best FROM quote_units q JOIN origins o ON o.conv_id = q.conv_id AND o.unit = q.unit
  WHERE origin < turn GROUP BY ALL),
parents AS (SELECT row, conv_id, turn, count(*) AS n_linked, min((level, best[2])) AS best FROM found GROUP BY ALL),
steps AS (SELECT conv_id, turn, max(-best[2]) AS parent_turn FROM parents GROUP BY ALL),
chains AS (
  SELECT conv_id, turn, parent_turn AS top, 1 AS depth FROM steps
  UNION ALL
  SELECT c.conv_id, c.turn, s.parent_turn, depth + 1 FROM chains c JOIN steps s ON s.conv_id = c.conv_id AND s.turn = c.top),
ends AS (SELECT conv_id, turn, max(depth) AS depth, min(top) AS top FROM chains GROUP BY ALL),
counts AS (SELECT row, count(*) AS n FROM quoted GROUP BY row)
SELECT m.conv_id, m.turn, role,
  CASE WHEN counts.n > 0 THEN trim(regexp_replace(coalesce(passage, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) ELSE m.text END AS text,
  parent_turn, coalesce(top, m.turn) AS thread, coalesce(depth, 0)::INT AS depth, coalesce(counts.n, 0)::INT AS n_quotes, coalesce(n_linked, 0)::INT AS n_linked
FROM m LEFT JOIN own USING (row) LEFT JOIN counts USING (row) LEFT JOIN parents USING (row)
  LEFT JOIN steps ON steps.conv_id = m.conv_id AND steps.turn = m.turn LEFT JOIN ends ON ends.conv_id = m.conv_id AND ends.turn = m.turn
"""


@query("op7_quotation_linking", SQL)
def quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
