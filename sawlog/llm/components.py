"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import narrow, stored


ROWS_PER_FILE = 100_000  # edges to a task when a step is written


def _kept(df: DataFrame, rows: int) -> DataFrame:
    """The frame as a table of as many files as about ``rows`` rows need: steps have far fewer rows than the texts."""
    return stored(df.coalesce(max(8, -(-rows // ROWS_PER_FILE))))


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step of the alternating star algorithm: neighbours of a node are linked to its smallest one.

    The minimum per node is pre-aggregated before it is shuffled, and stored. The join back is to that
    table: broadcast while it is small, else a plain join of two exchanges, which Spark can split where a
    node has very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
    joined = both.join(narrow(least), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return _kept(out.filter(F.col("u") != F.col("v")).distinct(), rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is the smallest node in it.

    Alternates large and small stars until nothing changes; each step is written to the shared
    folder. Self loops are dropped: a node that has no other edge doesn't come out. Null ends have no edge.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .filter(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not mark.n or mark == before:
            break
        before = mark
        edges = _star(_star(edges, True, mark.n), False, mark.n)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
