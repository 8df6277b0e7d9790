"""Query: toxicity of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.toxicity import report


@query("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
