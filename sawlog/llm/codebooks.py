"""Vector codes by Lloyd's rounds whose members stay with their owners."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import narrow, stored

OWNER_ROWS = 200_000  # parts an owner holds, about; entries with more are salted
BOUND = 1 << 26  # magnitude of whole components up to which squared distances of a part are exact
SCALE = 256


def whole(vectors: DataFrame, label: bool = True) -> DataFrame:
    """``vec_id, comps`` (and ``label``) of usable rows of ``vectors(vec_id, embedding)``: components as ``floor(256 * x)``.

    Rows whose vector is null or empty, or holds null or non-finite components, are left out.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(~bad)
    large = F.exists(x, lambda v: F.abs(v * SCALE) >= BOUND)
    comps = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    checked = F.when(large, F.raise_error(F.lit(f"components of {BOUND // SCALE} and more have no exact code"))).otherwise(comps)
    columns = [F.col("vec_id").cast("long").alias("vec_id"), checked.alias("comps")]
    return rows.select(*columns, *([F.col("label")] if label and "label" in vectors.columns else []))


def seeds(rows: DataFrame, entries: int) -> list[list[int]]:
    """Components of the smallest ``vec_id``s; ties go by components, rows without a number come last."""
    first = rows.select("vec_id", "comps").orderBy(F.asc_nulls_last("vec_id"), "comps").limit(entries)
    return [r.comps for r in first.collect()]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part; the first of equally near entries."""
    parts, entries = parts.astype(np.int64), entries.astype(np.int64)
    if max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0))) < 1 << 20:
        # Sums of products below 2**53: a product of matrices in double precision is exact.
        crossed = (parts.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
    else:
        crossed = parts @ entries.T
    far = (parts * parts).sum(axis=1)[:, None] - 2 * crossed + (entries * entries).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def members(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``position, entry, salt, part``: the parts of ``rows(comps)`` with the nearest entry of ``books[position, entry]``."""
    positions, _, width = books.shape

    def dealt(batches):
        for batch in batches:
            parts = _matrix(batch.column(0), positions * width).reshape(-1, positions, width)
            salts = np.asarray(batch.column(1))
            for at in range(positions):
                yield _members(parts[:, at], np.full(len(parts), at), nearest(parts[:, at], books[at])[0], salts)

    return rows.select("comps", F.xxhash64(F.monotonically_increasing_id()).alias("salt")).mapInArrow(
        dealt, "position int, entry int, salt long, part array<long>")


def _members(parts: np.ndarray, position: np.ndarray, entry: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
    width = parts.shape[1]
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * width, pa.int32()), pa.array(parts.reshape(-1).astype(np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int64()), listed], ["position", "entry", "salt", "part"])


def to_owners(parts: DataFrame, owners: int, salts: int) -> DataFrame:
    """Parts at their owners: one per position, entry and salt."""
    return parts.repartition(owners, "position", "entry", F.pmod("salt", F.lit(salts)))


def reassigned(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """Residents with their entry of before as ``home`` and the nearest entry of new books; nothing is moved."""
    width = books.shape[2]

    def told(batches):
        for batch in batches:
            position, home = np.asarray(batch.column(0)), batch.column(1)
            part = _matrix(batch.column(3), width)
            entry = np.zeros(len(part), np.int64)
            for at in np.unique(position):
                own = position == at
                entry[own] = nearest(part[own], books[at])[0]
            yield pa.RecordBatch.from_arrays([home, *_members(part, position, entry, np.asarray(batch.column(2))).columns],
                                             ["home", "position", "entry", "salt", "part"])

    return parts.mapInArrow(told, "home int, position int, entry int, salt long, part array<long>")


def updated(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """New books: each entry the floor of its members' mean, unused ones as before.

    Owners add up the members that reside with them; one row of sums per owner and entry goes on.
    """
    width = books.shape[2]

    def summed(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            group = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))
            part = _matrix(batch.column(3), width)
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.diff(group[order], prepend=-1))
            count = np.diff(np.append(first, len(group)))
            for key, n, total in zip(group[order][first].tolist(), count.tolist(), np.add.reduceat(part[order], first) if len(first) else [], strict=True):
                row = np.append(total, n)
                sums[key] = sums[key] + row if key in sums else row
        keys, rows = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, width + 1)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (width + 1), pa.int32()), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array([k >> 32 for k in keys], pa.int32()), pa.array([k & 0xFFFFFFFF for k in keys], pa.int32()), listed],
                                         ["position", "entry", "sums"])

    # Sums of many members may pass 64 bits; decimals do not.
    totals = (parts.mapInArrow(summed, "position int, entry int, sums array<long>").select("position", "entry", F.posexplode("sums").alias("at", "value"))
              .groupBy("position", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in totals.collect():  # one number per component of the books
        found.setdefault((r.position, r.entry), {})[r.at] = int(r.value)
    books = books.copy()
    for (position, entry), values in found.items():
        books[position, entry] = [values[i] // values[width] for i in range(width)]
    return books


def trained(rows: DataFrame, positions: int, entries: int, rounds: int, owner_rows: int = OWNER_ROWS) -> np.ndarray | None:
    """Codebooks ``[position, entry, component]`` after some rounds over ``rows(vec_id, comps)`` of one width, a stored frame.

    Parts go to the owners of their entries once. From then on owners add up resident members, and only parts whose entry has
    changed migrate. An entry with any share of all members has as many owners as it needs, by salt.
    """
    first = seeds(rows, entries)
    if not first:
        return None
    books = np.array(first, np.int64).reshape(len(first), positions, -1).transpose(1, 0, 2)
    if not rounds:
        return books
    n = rows.count()
    salts, owners = max(1, -(-n // owner_rows)), max(1, -(-n * positions // owner_rows))
    held = stored(to_owners(members(rows, books), owners, salts))
    for number in range(1, rounds + 1):
        books = updated(held, books)
        if number < rounds:
            told = stored(reassigned(held, books))
            stay, move = told.filter("entry = home").drop("home"), told.filter("entry <> home").drop("home")
            held = stay.unionByName(to_owners(move, owners, salts))
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` (two hex digits for each part) and ``error`` (squared distances); nothing is shuffled."""
    positions, _, width = books.shape
    others = [c for c in rows.columns if c != "comps"]

    def run(batches):
        for batch in batches:
            parts = _matrix(batch.column(0), positions * width).reshape(-1, positions, width)
            told = [nearest(parts[:, at], books[at]) for at in range(positions)]
            codes = np.stack([best for best, _ in told], axis=1).astype(np.uint8)
            error = np.sum([far for _, far in told], axis=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], [*others, "code", "error"])

    schema = rows.select(*others).schema.simpleString()[len("struct<"):-1]
    return rows.select("comps", *others).mapInArrow(run, f"{schema},code:string,error:bigint")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2, owner_rows: int = OWNER_ROWS) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of ``vectors(vec_id, embedding, label)`` and the codebooks they refer to.

    Returns ``vec_id, label, code, error`` for each usable row, repeated ones too, and books ``[position, entry, component]``, or None where
    no row is usable. All vectors have the width of that with the smallest ``vec_id``; rows of another width are left out, and that width must
    divide into ``positions`` parts. A null ``vec_id`` is coded, but is a seed only where numbers are too few. With fewer rows than
    ``entries`` there are as many entries as rows. Components must be below 2**18, so that all arithmetic is exact; larger ones are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, so that two hex digits hold an index")
    rows = stored(whole(vectors.select("vec_id", "embedding", *(["label"] if "label" in vectors.columns else []))))
    first = seeds(rows, 1)
    width = len(first[0]) if first else 0
    if width % positions:
        raise ValueError(f"vectors of {width} components do not divide into {positions} parts")
    rows = rows.filter(F.size("comps") == width)
    books = trained(rows, positions, entries, rounds, owner_rows)
    if books is None:
        return rows.drop("comps").withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")}), None
    return coded(rows, books), books


def report(vectors: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; rows without a label are one label."""
    rows, books = compressed(vectors, positions, entries, rounds)
    rows = stored(rows.withColumns({"known": F.col("label").isNotNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    labels = stored(rows.groupBy("known", "name").agg(F.sum("error").alias("label_error")))
    return rows.join(narrow(labels), ["known", "name"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
