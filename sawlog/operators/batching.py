"""Consecutive batches of records and the request bodies made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.functions.jsonfmt import json_string, log_json, rfc3339
from sawlog.functions.text import resolve_index
from sawlog.operators.filters import webhook_min_level
from sawlog.operators.metrics import summary_text
from sawlog.operators.ranking import number_rows

BULK_SIZE, MAX_BULK_SIZE = 500, 10_000
WEBHOOK_SIZE, MAX_WEBHOOK_SIZE = 10, 100


def batch_size(size: int | None, default: int, largest: int | None) -> int:
    """The asked size, or the default; one over ``largest`` raises, unless that is None."""
    if not size or size <= 0:
        return default
    if largest is not None and size > largest:
        raise ValueError(f"batch size must be <= {largest}")
    return size


def batch_records(df: DataFrame, size: int, order: str = "line_id") -> DataFrame:
    """Add ``batch`` (from 0) and ``place`` in it: consecutive records in the order of a unique id.

    Every batch but the last is full. The numbering is global without a global sort.
    """
    numbered = number_rows(df, order, "_no")
    return numbered.withColumns({
        "batch": F.expr(f"_no div {size}"), "place": (F.col("_no") % size).cast("int"),
    }).drop("_no")


def _joined(parts: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p.text), glue)


def bulk_bodies(
    df: DataFrame, index: str, size: int | None = None, sent_at: str = "ts", with_ids: bool = False,
    order: str = "line_id", largest: int | None = MAX_BULK_SIZE,
) -> DataFrame:
    """Bulk request bodies ``(batch, docs, bulk_body)``: an action line and a document line per record.

    Date parts of the index name come from the ``sent_at`` column. With ``with_ids`` each document
    has an id made of source and order, so that a repeated request does not add it again.
    """
    count = batch_size(size, BULK_SIZE, largest)
    batched = batch_records(df, count, order)
    doc_id = F.sha2(F.concat_ws("|", "source", F.col(order).cast("string")), 256)
    extra = F.concat(F.lit(',"_id":"'), doc_id, F.lit('"')) if with_ids else F.lit("")
    fields = F.col("fields") if "fields" in df.columns else F.create_map().cast("map<string,variant>")
    text = F.concat(
        F.lit('{"index":{"_index":"'), resolve_index(index, F.col(sent_at)), F.lit('"'), extra, F.lit("}}\n"),
        log_json(F.col("ts"), F.col("level"), F.col("message"), F.col("source"), fields), F.lit("\n"),
    )
    # A batch holds at most ``size`` documents, so the lists are bounded.
    grouped = batched.groupBy("batch").agg(
        F.count("*").alias("docs"), F.collect_list(F.struct("place", text.alias("text"))).alias("_parts")
    )
    return grouped.select("batch", "docs", _joined(F.col("_parts"), "").alias("bulk_body"))


def webhook_payloads(
    df: DataFrame, sent_at: Column, min_level: str | None = None, size: int | None = None, app: str = "Sawlog",
    order: str = "line_id", largest: int | None = MAX_WEBHOOK_SIZE,
) -> DataFrame:
    """Webhook bodies ``(batch, count, payload, first_id, last_id)`` of lines from ``min_level`` on; the ids are those of its first and last line."""
    count = batch_size(size, WEBHOOK_SIZE, largest)
    batched = batch_records(webhook_min_level(df, min_level), count, order)
    item = F.concat(
        F.lit('{"timestamp":"'), rfc3339(F.col("ts"), fraction=False), F.lit('","level":'), json_string(F.upper("level")),
        F.lit(',"message":'), json_string(F.col("message")), F.lit(',"source":'), json_string(F.col("source")), F.lit("}"),
    )
    # One numbering and one grouping give both the lines and their summary.
    grouped = batched.groupBy("batch").agg(
        F.count("*").alias("count"), F.min(order).alias("first_id"), F.max(order).alias("last_id"),
        F.collect_list(F.struct("place", item.alias("text"), F.upper("level").alias("level"))).alias("_parts"))
    text = F.concat(F.lit(f"{app}: "), summary_text(F.col("count"), F.transform("_parts", lambda p: p.level)))
    return grouped.select(
        "batch", "count",
        F.concat(
            F.lit('{"text":'), json_string(text),
            F.lit(',"logs":['), _joined(F.col("_parts"), ","), F.lit('],"count":'), F.col("count").cast("string"),
            F.lit(',"sent_at":"'), rfc3339(sent_at, fraction=False), F.lit('"}'),
        ).alias("payload"), "first_id", "last_id",
    )
