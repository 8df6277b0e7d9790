"""Query: nearest neighbours in ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.neighbours import nearest

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: (x IS NULL OR NOT isfinite(x))::INT)) = 0
    AND list_sum(list_transform(embedding, lambda x: (x <> 0)::INT)) > 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) WHERE rank <= 10
"""


@query("op10_one_bit_codes", SQL)
def one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)
