"""Query: bytes of ``documents`` that occur more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.repeated_bytes import removal_report


@query("op9_suffix_buckets")
def suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"), 400)
