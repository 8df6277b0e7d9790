"""Query: words of ``documents`` that repeat earlier documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.repeated_words import removal_report


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, p, w[p:p + 12] AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS k FROM g JOIN f USING (s) WHERE first < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM u ANTI JOIN r USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op6_substring_dedup", SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"), 13)
