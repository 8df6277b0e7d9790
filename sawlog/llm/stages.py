"""The operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sawlog.llm.common import key_columns, narrow, stored, table
from sawlog.llm.decontamination import contamination
from sawlog.llm.near_duplicates import near_duplicates
from sawlog.llm.op2 import tokenizer_path
from sawlog.llm.packing import crc32, pack_documents
from sawlog.llm.secrets import redacted, trained
from sawlog.llm.toxicity import fit

THRESHOLD = 0.7


def _held(docs: DataFrame, **columns: Column) -> DataFrame:
    """Rows kept aside as one column, so that theirs may have any names, beside some new ones."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def _given(held: DataFrame, docs: DataFrame) -> DataFrame:
    return held.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _keys() -> dict[str, Column]:
    return dict(zip(("id", "tag"), key_columns(), strict=True))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under the threshold."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = _held(docs, text=F.col("text"))
    return _given(model.scored(held, name="score").filter(F.col("score") < THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest ``doc_id``.

    Texts are compared, not ids: rows of one ``doc_id`` with different texts are different documents, of which the one with the smallest hash is first. Rows that repeat
    both are one. Rows without ``doc_id`` stay.
    """
    node = F.when(F.col("doc_id").isNotNull(), F.xxhash64(*key_columns()))
    held = _held(docs, node=node, **_keys())
    groups = near_duplicates(docs.select(node.alias("doc_id"), "text"))
    # Members of groups, by node; the smallest of each stays.
    joined = stored(groups.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "component_id").distinct())
    many = joined.filter("node <> component_id").select("component_id").distinct()
    members = stored(held.select("node", "id", "tag").join(joined.join(many, "component_id", "left_semi"), "node").distinct())
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "tag", "node")).alias("first")).select(F.col("first.node").alias("node"))
    lost = stored(members.select("node").distinct().join(first, "node", "left_anti"))
    kept = held.join(narrow(lost), "node", "left_anti")
    repeated = stored(held.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"))
    if not repeated.head(1):
        return _given(kept, docs)
    once = kept.join(narrow(repeated), "node", "left_semi").dropDuplicates(["node"])
    return _given(kept.join(narrow(repeated), "node", "left_anti").select("row").unionByName(once.select("row")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    lost = stored(found.filter("contaminated").select("id", "tag").distinct())
    return _given(_held(docs, **_keys()).join(narrow(lost), ["id", "tag"], "left_anti"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` brought up to date."""
    clean = redacted(docs, trained(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack_documents(docs, tokenizer_path(), 4096, 1, crc32).withColumnRenamed("ids", "ids_crc32")
