"""Greedy anchored windows, exact for keys of any size.

For each key with ordered positions, the first position opens a window that holds all
positions up to ``anchor + width``; the first one past it opens the next window. Where a
window starts depends on the one before, so a plain scan is sequential per key. Here a key
is cut into blocks of many widths each:

1.  In a block, positions closer than ``width`` form segments. A segment no longer than
    ``width`` and away from the block's edges is one window, whatever came before. That is
    decided by JVM window functions and settles nearly all sparse data.
2.  For the rest, each block is summarised on its own: only a position in its first width
    can be its first anchor, and each of those leads to one last anchor. Chains that meet stay
    together, so a long block has few distinct outcomes.
3.  The summaries of a key are chained in block order: a look-up per block.
4.  Knowing the anchor each block starts from, all blocks list their windows in parallel.

Steps 2 to 4 stream over sorted partitions in Arrow batches; a group need not fit a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

MAX_WIDTH = 2**60
_CHUNK_ROWS = 200_000


def anchored_windows(points: DataFrame, keys: list[str], widths: int = 64, min_span: int = 1) -> DataFrame:
    """Windows ``(keys, p, n, last, tag)`` of ``points(keys, p, w, n, tag)``.

    ``p`` is a LONG position, unique per key, ``w`` the width, constant per key and not negative,
    ``n`` the number of rows at the position, ``tag`` a LONG that stands for them. In the result
    ``p`` and ``tag`` are the anchor's, ``n`` the rows in the window and ``last`` its last position.
    A block spans ``widths`` widths and no less than ``min_span``.
    """
    span = F.greatest((F.least("w", F.lit(MAX_WIDTH // widths)) + 1) * widths, F.lit(min_span))
    rows = points.select(*keys, "p", "w", "n", "tag", span.alias("_span"))
    rows = rows.withColumn("blk", F.col("p") - F.expr("pmod(p, _span)"))
    # Said once here, so that no branch adds a null check of its own and all reuse one exchange.
    rows = rows.where("p IS NOT NULL AND w IS NOT NULL AND n IS NOT NULL AND blk IS NOT NULL")

    in_block = Window.partitionBy(*keys, "blk").orderBy("p")
    gap = F.col("p") - F.lag("p").over(in_block)
    opens = F.when(gap <= F.col("w"), F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("_opens", opens)
    rows = rows.withColumn("_seg", F.sum("_opens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    segment = Window.partitionBy(*keys, "blk", "_seg")
    rows = rows.withColumns({
        "_first": F.min("p").over(segment),
        "last": F.max("p").over(segment),
        "_total": F.sum("n").over(segment),
    })
    settled = (
        (F.col("last") - F.col("_first") <= F.col("w"))
        & (F.col("_first") >= F.col("blk") + F.col("w"))
        & (F.col("last") < F.col("blk") + F.col("_span") - F.col("w"))
    )
    alone = rows.where(settled & (F.col("p") <= F.col("_first"))).select(
        *keys, "p", F.col("_total").alias("n"), "last", "tag"
    )
    chained = _chained_windows(rows.where(~settled).select(*keys, "blk", "p", "w", "n", "tag"), keys)
    return alone.unionByName(chained)


def _chained_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    group = [*keys, "blk"]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    row_ddl = f"{key_ddl}, blk bigint, p bigint, w bigint, n bigint, tag bigint"

    # All columns go along unused, so that this branch reads the same exchange as the others.
    entries = rows.withColumn("hi", F.col("p"))
    outcomes = (
        entries.repartition(*group).sortWithinPartitions(*group, "p")
        .mapInArrow(_streaming(group, _block_outcomes), f"{row_ddl}, hi bigint")
    )
    carried = (
        outcomes.repartition(*keys).sortWithinPartitions(*keys, "blk", "hi")
        .mapInArrow(_carry(keys), f"{row_ddl}, last bigint")
    )
    marked = rows.withColumn("last", F.col("p")).unionByName(carried)
    windows = (
        marked.repartition(*group).sortWithinPartitions(*group, "p")
        .mapInArrow(_streaming(group, _block_windows), f"{row_ddl}, last bigint")
    )
    # A window that crosses a block edge comes in parts under one anchor; one part has its tag.
    return windows.groupBy(*keys, "p").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.max("tag").alias("tag")
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= _CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Offsets where a run of equal keys begins."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for name in names:
        column = table.column(name).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        change[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(change)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _replaced(table: pa.Table, name: str, values: np.ndarray) -> pa.Table:
    place = table.schema.get_field_index(name)
    return table.set_column(place, table.schema.field(place), pa.array(values, pa.int64()))


def _past(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each range ``[lo, hi)`` of the sorted runs in ``p``, the first index with ``p > limit``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        unsure = lo < hi
        if not unsure.any():
            return lo
        mid = (lo + hi) >> 1
        inside = unsure & (p[np.minimum(mid, len(p) - 1)] <= limit)
        lo = np.where(inside, mid + 1, lo)
        hi = np.where(unsure & ~inside, mid, hi)


def _ends_of_chains(follower: np.ndarray) -> np.ndarray:
    """Where the chain of each row ends, a row that follows itself; steps double, so a long chain takes few rounds."""
    while True:
        twice = follower[follower]
        if np.array_equal(twice, follower):
            return follower
        follower = twice


def _chained_from(starts: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """The rows on the chains of ``starts``, in order; steps double here too."""
    reached = np.zeros(len(follower), dtype=bool)
    reached[starts] = True
    while True:
        reached[follower[np.flatnonzero(reached)]] = True
        twice = follower[follower]
        if np.array_equal(twice, follower):
            return np.flatnonzero(reached)
        follower = twice


def _streaming(group: list[str], step):
    """Run ``step`` chunk by chunk over partitions sorted by group.

    ``step(table, starts, kept)`` returns rows of the same format and the offset from which they
    belong to the last group. Those are put before the next chunk, where ``kept`` counts them,
    so a group of any length needs only its own summary in memory.
    """

    def run(batches):
        held = None
        for table in _chunks(batches):
            kept = 0
            if held is not None:
                kept = held.num_rows
                table = pa.concat_tables([held, table]).combine_chunks()
            table, open_from = step(table, _group_starts(table, group), kept)
            yield from table.slice(0, open_from).to_batches()
            held = table.slice(open_from)
        if held is not None:
            yield from held.to_batches()

    return run


def _block_outcomes(table: pa.Table, starts: np.ndarray, kept: int) -> tuple[pa.Table, int]:
    """Reduce each group to runs of entry positions (``hi`` = last of the run) with equal last anchor ``p``.

    The first ``kept`` rows are runs of the chunk before, with the anchors reached so far.
    """
    p, w, hi, blk = (_longs(table, c) for c in ("p", "w", "hi", "blk"))
    ends = np.append(starts[1:], len(p))
    group_end = np.repeat(ends, ends - starts)
    is_entry = np.zeros(len(p), dtype=bool)
    is_entry[starts] = True
    is_entry[:kept] = True
    before = np.append(p[:1], p[:-1])
    if kept and kept < len(p):
        before[kept] = p[:kept].max()
        is_entry[kept] = kept in starts
    edge = blk - 1 + w
    is_entry |= p <= edge
    same_group = np.ones(len(p), dtype=bool)
    same_group[starts] = False
    is_entry |= same_group & (before <= edge)
    entry = np.flatnonzero(is_entry)
    place = np.arange(len(p))
    # Anchors kept from before all lie ahead of the rows of this chunk.
    ahead = _past(p, np.minimum(np.maximum(place + 1, kept), group_end), group_end, p + w)
    at = _ends_of_chains(np.where(ahead < group_end, ahead, place))[entry]
    # Neighbours that end at one anchor form a run; the last one names it.
    group_of = np.searchsorted(starts, entry, "right")
    last_of_run = np.append((p[at][1:] != p[at][:-1]) | (group_of[1:] != group_of[:-1]), True)
    chosen, anchor = entry[last_of_run], at[last_of_run]
    out = table.take(pa.array(chosen)).combine_chunks()
    out = _replaced(out, "p", p[anchor])
    return out, int(np.searchsorted(chosen, starts[-1]))


def _carry(keys: list[str]):
    """Chain the block outcomes of a key; emit the anchor that reaches into a block."""

    def run(batches):
        key, anchor = None, None
        pending: dict | None = None
        for table in _chunks(batches):
            starts = _group_starts(table, [*keys, "blk"])
            ends = np.append(starts[1:], table.num_rows)
            p, w, hi, blk = (_longs(table, c) for c in ("p", "w", "hi", "blk"))
            names = list(zip(*(table.column(k).take(pa.array(starts)).to_pylist() for k in keys)))
            rows, carried = [], []
            for name, lo, end in zip(names, starts.tolist(), ends.tolist()):
                block = int(blk[lo])
                if name != key:
                    key, anchor, pending = name, None, None
                if pending is None or pending["block"] != block:
                    pending = {"block": block, "from": anchor, "done": False}
                    if anchor is not None and anchor + int(w[lo]) >= block:
                        rows.append(lo)
                        carried.append(anchor)
                if not pending["done"]:
                    came = pending["from"]
                    reach = None if came is None else came + int(w[lo])
                    hit = lo if reach is None else lo + int(np.searchsorted(hi[lo:end], reach, "right"))
                    if hit < end:
                        anchor, pending["done"] = int(p[hit]), True
            if rows:
                anchors = np.array(carried, dtype=np.int64)
                out = table.take(pa.array(rows)).drop_columns("hi")
                out = _replaced(_replaced(out, "p", anchors), "n", np.zeros_like(anchors))
                out = _replaced(out, "tag", np.full_like(anchors, np.iinfo(np.int64).min))
                yield from out.append_column("last", pa.array(anchors)).combine_chunks().to_batches()

    return run


def _block_windows(table: pa.Table, starts: np.ndarray, kept: int) -> tuple[pa.Table, int]:
    """Walk each group from its first row; rows become windows, the last one still open."""
    p, w, n, last = (_longs(table, c) for c in ("p", "w", "n", "last"))
    sums = np.concatenate([[0], np.cumsum(n)])
    group_end = np.repeat(np.append(starts[1:], len(p)), np.diff(np.append(starts, len(p))))
    place = np.arange(len(p))
    ahead = _past(p, place + 1, group_end, p + w)
    anchor = _chained_from(starts, np.where(ahead < group_end, ahead, place))
    end = ahead[anchor]
    out = table.take(pa.array(anchor)).combine_chunks()
    out = _replaced(_replaced(out, "n", sums[end] - sums[anchor]), "last", last[end - 1])
    return out, out.num_rows - 1
