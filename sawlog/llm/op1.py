"""Query: secrets in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.secrets import report


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
