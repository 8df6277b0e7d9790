"""Query: codes of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.codebooks import report
from sawlog.llm.common import table

_NEAREST = """
  SELECT vec_id, m, {keep} x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT p.*, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT AS d
    FROM p JOIN {books} b USING (m)) GROUP BY ALL
"""
_UPDATE = """
  SELECT b.m, b.e, CASE WHEN s.x IS NULL THEN b.x ELSE s.x END AS x FROM {books} b LEFT JOIN (
    SELECT m, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT m, e, i, sum(x[i])::DOUBLE AS total, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM {told}) GROUP BY ALL) GROUP BY m, e) s
  ON b.m = s.m AND b.e = s.e
"""
SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda c: (c IS NULL OR NOT isfinite(c))::INT)) = 0),
p AS (SELECT vec_id, m, x[m * len(x) // 16 + 1:(m + 1) * len(x) // 16] AS x FROM (SELECT *, unnest(range(16)) AS m FROM v)),
b0 AS (SELECT m, (row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1)::INT AS e, x FROM p QUALIFY e < 64),
a1 AS ({_NEAREST.format(books="b0", keep="")}),
b1 AS ({_UPDATE.format(books="b0", told="a1")}),
a2 AS ({_NEAREST.format(books="b1", keep="")}),
b2 AS ({_UPDATE.format(books="b1", told="a2")}),
a3 AS ({_NEAREST.format(books="b2", keep="")}),
c AS (SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY m) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id),
h AS (SELECT lower(sha256(string_agg(array_to_string(x, ','), ',' ORDER BY m, e))) AS codebooks_sha256 FROM b2)
SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM c JOIN v USING (vec_id), h
"""


@query("op12_vector_codes", SQL)
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "embeddings"), 16, 64, 2)
