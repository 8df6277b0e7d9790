"""Global order without a global sort.

A total order over all rows, or over one hot key, must not run through one task. The order
is cut into buckets; only one row per bucket meets in a per-key window, and rows are ordered
inside their bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sawlog.session import stored

# Rows with equal position are split by their id in runs of this many bits.
ID_BITS = 20
BUCKET_US = 60_000_000
BUCKET_ROWS = 200_000
# Parts a bucket is cut into at once. More levels, not wider ones, serve larger tables.
FAN = 4096


def _before(partition: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(w), F.lit(0))


def _cuts(ids: DataFrame, id_col: str, rows: int) -> list[float]:
    """Ids that cut ``rows`` rows into buckets of about ``BUCKET_ROWS``, whatever the ids are and however many.

    One aggregation with a sketch of bounded size per bucket cuts it into up to ``FAN`` parts, and parts that are
    still too large are cut again. The driver holds one number for each bucket.
    """
    cuts: list[float] = []
    largest = rows
    while largest > BUCKET_ROWS:
        fan = min(FAN, -(-largest // BUCKET_ROWS))
        sketch = F.percentile_approx(F.col(id_col).cast("double"), F.lit([i / fan for i in range(1, fan)]), F.lit(16 * fan))
        found = _bucketed(ids.select(id_col), id_col, cuts).groupBy("_bucket").agg(F.count("*").alias("n"), sketch.alias("cuts"))
        more = set(cuts)
        for bucket in found.where(F.col("n") > BUCKET_ROWS).toLocalIterator():
            step = max(1, fan // -(-bucket.n // BUCKET_ROWS))
            more.update(bucket.cuts[step - 1 :: step])
        if len(more) == len(cuts):
            break  # ids that are one number as doubles cannot be told apart: at most 1,024 of them
        cuts = sorted(more)
        largest = -(-largest // fan)
    return cuts


def _bucketed(df: DataFrame, id_col: str, cuts: list[float]) -> DataFrame:
    """Adds ``_bucket``: numbers that grow with the id."""
    splits = [float("-inf"), *cuts, float("inf")]
    held = df.withColumn("_at", F.col(id_col).cast("double"))
    if len(splits) < 3:
        return held.withColumn("_bucket", F.lit(0)).drop("_at")
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol="_in", handleInvalid="keep").transform(held)
    return cut.withColumn("_bucket", F.col("_in").cast("int")).drop("_at", "_in")


def number_rows(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique LONG id.

    The input is computed once and stored. Where it has more than ``BUCKET_ROWS`` rows it is cut into buckets of about
    that size, for dense and for hashed ids alike, and rows are ordered inside their bucket. Counts of the buckets are
    added up in two levels, so that no task sees more than ``FAN`` of them or one for each ``FAN``.
    """
    held = stored(df)
    rows = held.count()
    if rows <= BUCKET_ROWS:
        return held.withColumn(out, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(id_col)) - 1).cast("bigint"))
    keyed = _bucketed(held, id_col, _cuts(held, id_col, rows))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_span", F.expr(f"_bucket div {FAN}"))
    spans = counts.groupBy("_span").agg(F.sum("_n").alias("_n")).select("_span", _before([], ["_span"]).alias("_base"))
    inner = counts.select("_span", "_bucket", _before(["_span"], ["_bucket"]).alias("_inner"))
    starts = inner.join(spans, "_span").select("_bucket", (F.col("_base") + F.col("_inner")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col))
    # Spark broadcasts the starts where they are small: two numbers for each BUCKET_ROWS rows.
    return (
        keyed.withColumn("_place", place).join(starts, "_bucket")
        .withColumn(out, F.col("_start") + F.col("_place") - 1)
        .drop("_bucket", "_place", "_start")
    )


def rank_in_key(df: DataFrame, key: str, at: str, id_col: str, out: str) -> DataFrame:
    """Rank from 1 of each row of a key in the order of ``(at, id_col)``, ``at`` in microseconds.

    A key is split by time, and rows of one instant by id, so neither a hot key nor a burst
    at one instant is sorted in one task.
    """
    keyed = df.withColumns({
        "_tb": F.expr(f"{at} div {BUCKET_US}"),
        "_ib": F.shiftright(F.col(id_col), ID_BITS),
    })
    runs = keyed.groupBy(key, "_tb", at, "_ib").agg(F.count("*").alias("_n"))
    buckets = runs.groupBy(key, "_tb").agg(F.sum("_n").alias("_n"))
    buckets = buckets.select(key, "_tb", _before([key], ["_tb"]).alias("_base"))
    runs = runs.withColumn("_inner", _before([key, "_tb"], [at, "_ib"]))
    starts = runs.join(buckets, [key, "_tb"]).select(
        key, "_tb", at, "_ib", (F.col("_base") + F.col("_inner")).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy(key, "_tb", at, "_ib").orderBy(id_col))
    return (
        keyed.withColumn("_place", place).join(starts, [key, "_tb", at, "_ib"])
        .withColumn(out, F.col("_start") + F.col("_place"))
        .drop("_tb", "_ib", "_place", "_start")
    )


def newest(df: DataFrame, by: str, limit: int) -> DataFrame:
    """The rows with the ``limit`` highest values of a unique LONG, highest first.

    The ids alone are stored first. Bucket counts tell from which id on rows are needed, and the bucket in which that id
    lies is cut again until it is small, so only about ``limit`` rows of the input are sorted.
    """
    if limit <= 0:
        return df.limit(0)
    ids = stored(df.select(by))
    above, held, lowest = 0, ids.count(), None
    while held > max(BUCKET_ROWS, limit - above):
        fan = min(FAN, -(-held // BUCKET_ROWS) + 1)
        place = F.col(by).cast("double")
        sketch = F.percentile_approx(place, F.lit([i / fan for i in range(1, fan)]), F.lit(16 * fan))
        cuts = sorted(set(ids.agg(sketch.alias("cuts")).first().cuts))
        counts = {r._bucket: r["count"] for r in _bucketed(ids, by, cuts).groupBy("_bucket").count().collect()}
        bucket = len(cuts)
        while bucket > 0 and above + counts.get(bucket, 0) < limit:
            above += counts.get(bucket, 0)
            bucket -= 1
        if bucket:
            lowest = cuts[bucket - 1]
        if counts.get(bucket, 0) == held:
            break  # ids that are one number as doubles
        held = counts.get(bucket, 0)
        ids = ids.where((place >= (cuts[bucket - 1] if bucket else float("-inf"))) & (place < (cuts[bucket] if bucket < len(cuts) else float("inf"))))
    needed = df if lowest is None else df.where(F.col(by).cast("double") >= lowest)
    return needed.orderBy(F.desc(by)).limit(limit)
