"""Query: ``documents`` scored by a mixing language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.mixing import report


@query("op11_context_mixing")
def context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
