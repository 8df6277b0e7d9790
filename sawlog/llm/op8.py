"""Query: ``pages`` through a content-addressed archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.archive import archive_report
from sawlog.llm.catalog import query
from sawlog.llm.common import table

SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT *, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 10 * (i // 8):10 + 10 * (i // 8)])::BIGINT >> (5 * (7 - i % 8))) & 31)]),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""


@query("op8_content_addressed_archive", SQL)
def content_addressed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))
