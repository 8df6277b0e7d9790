"""A corpus made ready for training: ``documents`` through five stages, each written as Parquet and read again.

Toxic documents go, one document of each group of near duplicates stays, documents with benchmark passages go, secrets are
blanked out, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawlog.llm import stages
from sawlog.llm.common import folder, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack),
]

#: Trees, hashing and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
