"""Query: ``documents`` packed into sequences."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from sawlog.llm.catalog import query
from sawlog.llm.common import table
from sawlog.llm.packing import crc32, pack_documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A vocabulary file: in ``TOKENIZER_DIR`` if that is set, else where the installed package has it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_two_fit")
def best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1, crc32)
    return rows.select("doc_id", "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset")
