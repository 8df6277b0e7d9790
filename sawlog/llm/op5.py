"""Query: near duplicates among ``documents``."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.near_duplicates import near_duplicates


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[p:p + 2] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
FROM reach LEFT JOIN c USING (doc_id) GROUP BY doc_id, c.n
"""


@query("op5_bbit_minhash", SQL)
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
