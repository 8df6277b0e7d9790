"""Query: ``benchmark`` passages in ``documents``."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import KEY, table
from sawlog.llm.decontamination import WORDS, contamination

SQL = f"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}'), []) AS w
  FROM documents),
iw AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}') AS w
    FROM benchmark) WHERE len(w) > 0),
ik AS (SELECT DISTINCT item_id, k, w[p:p + k - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM iw)),
dk AS (
  SELECT doc_id, p, k, w[p:p + k - 1] AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM dw CROSS JOIN (SELECT DISTINCT k FROM ik) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, k, g FROM dk JOIN (SELECT DISTINCT k, g FROM ik) USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM h) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h JOIN ik USING (k, g)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op3_winnowing", SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10).drop(*KEY)
