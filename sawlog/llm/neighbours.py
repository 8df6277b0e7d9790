"""Nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import stored

BLOCK = 131_072  # components of an index block: 2,048 vectors of 64
QUERIES = 512  # queries of a query block
SPREAD = 8  # index blocks that meet the same copy of a query block
MEAN_ROWS = 10_000  # about as many vectors give the centre
WIDTH = 4.0  # standard deviations of the estimate's error that the bounds allow for


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of rows with an id and a finite, non-zero vector without nulls."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False)))


def centres(vectors: DataFrame, rows: int = MEAN_ROWS) -> dict[int, list[float]]:
    """The mean vector of about ``rows`` vectors of each dimension, chosen by a hash of the id."""
    n = vectors.count()
    share = min(1_000_000, int(1_000_000 * rows / max(1, n)) + 1)
    some = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share)
    means = (some.select(F.size("vector").alias("dim"), F.posexplode("vector").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("x"))
             .groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs")).collect())
    return {r.dim: [x.x for x in r.xs] for r in means}


def encoded(matrix: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated residuals, their lengths, and the cosine between each residual and its code."""
    turned = (matrix - centre) @ rotation(matrix.shape[1]).T
    size = np.linalg.norm(turned, axis=1)
    cosine = np.abs(turned).sum(axis=1) / np.maximum(size, 1e-300) / np.sqrt(matrix.shape[1])
    return np.packbits(turned > 0, axis=1), size, np.where(size > 0, cosine, 1.0)


_BLOCK = "dim int, block long, n int, ids binary, vectors binary, codes binary, sizes binary, cosines binary"


def index(vectors: DataFrame, means: dict[int, list[float]], block: int = BLOCK) -> DataFrame:
    """Blocks of neighbouring rows, one row each: ids, vectors, codes and correction scalars. Nothing is shuffled."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def made(dim: int, ids: list, rows: list) -> pa.RecordBatch:
            matrix = np.array(rows, np.float64)
            codes, size, cosine = encoded(matrix, np.array(means.get(dim, [0.0] * dim)))
            key = np.array(ids, np.int64)
            values = [[dim], [int(key[0]) ^ len(ids) << 40], [len(ids)], *([a.tobytes()] for a in (key, matrix, codes, size, cosine))]
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            names = ["dim", "block", "n", "ids", "vectors", "codes", "sizes", "cosines"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(vector), ([], []))
                ids.append(key)
                rows.append(vector)
                if len(ids) >= max(64, block // max(1, len(vector))):
                    yield made(len(vector), ids, rows)
                    del held[len(vector)]
        for dim, (ids, rows) in held.items():
            yield made(dim, ids, rows)

    return vectors.select("vec_id", "vector").mapInArrow(run, _BLOCK)


_FOUND = "query_id long, vec_id long, score double"


def _distances(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added up in order."""
    total = np.zeros(len(matrix))
    for d in range(matrix.shape[1]):
        gap = matrix[:, d] - query[d]
        total += gap * gap
    return np.sqrt(total)


def _search(k: int, means: dict[int, list[float]], width: float):
    """The ``k`` nearest of one index block to each query of one query block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, n = row["dim"], row["n"]
                read = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: B023, E731
                ids, matrix = read("ids", np.int64), read("vectors", np.float64).reshape(n, dim)
                size, cosine = read("sizes", np.float64), read("cosines", np.float64)
                bits = np.unpackbits(read("codes", np.uint8).reshape(n, -1), axis=1, count=dim)
                signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
                q_ids = read("q_ids", np.int64)
                queries = read("q_vectors", np.float64).reshape(len(q_ids), dim)
                turned = (queries - np.array(means.get(dim, [0.0] * dim))) @ rotation(dim).T
                q_size = np.linalg.norm(turned, axis=1)
                # The code's inner product with the query, over its cosine with the vector, estimates the vector's own.
                inner = (signs @ turned.T.astype(np.float32)).astype(np.float64) / cosine[:, None]
                error = width * np.sqrt(np.maximum(1 - cosine**2, 0) / np.maximum(dim - 1, 1))[:, None] / cosine[:, None] * q_size[None, :]
                base = size[:, None] ** 2 + q_size[None, :] ** 2
                guess, slack = base - 2 * size[:, None] * inner, 2 * size[:, None] * error + 1e-5 * base
                out = []
                for j, key in enumerate(q_ids):
                    others = ids != key
                    upper, lower = (guess[:, j] + slack[:, j])[others], (guess[:, j] - slack[:, j])[others]
                    if len(upper) > k:
                        chosen = np.flatnonzero(others)[lower <= np.partition(upper, k - 1)[k - 1]]
                    else:
                        chosen = np.flatnonzero(others)
                    exact = _distances(matrix[chosen], queries[j])
                    best = np.lexsort((ids[chosen], exact))[: 2 * k]
                    seen = set()
                    for b in best:
                        if len(seen) == k:
                            break
                        if (i := int(ids[chosen[b]])) not in seen:
                            seen.add(i)
                            out.append((int(key), i, float(exact[b])))
                    if len(best) == 2 * k and len(seen) < k:  # many rows with one id: look at all of them
                        out = [o for o in out if o[0] != key]
                        nearest: dict[int, float] = {}
                        for i, d in zip(ids[others].tolist(), _distances(matrix[others], queries[j]).tolist(), strict=True):
                            nearest[i] = min(d, nearest.get(i, d))
                        out += [(int(key), i, d) for i, d in sorted(nearest.items(), key=lambda x: (x[1], x[0]))[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                                  pa.array([o[2] for o in out], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, width: float = WIDTH) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` to each of ``queries`` (same columns), by Euclidean distance.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller id. Rows that share an id count once, with their nearest vector, and a
    query id that has several vectors takes the smallest. A vector that is null, zero, or has null or non-finite components takes no
    part; vectors of different dimensions are never compared. Other columns are not read.

    Every vector's residual to a centre is rotated at random and kept as signs, its length, and its cosine with the signs. Codes
    estimate the distance to a query with a known error; only vectors whose lower bound is within the ``k``-th upper bound of their block
    are measured exactly. Index blocks meet query blocks by a join on a dealt key: each block pair is a row of bounded
    size, and only ``k`` rows per query and block are shuffled on.
    """
    vectors = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    means = centres(vectors)
    blocks = stored(index(vectors, means))
    groups = max(1, -(-blocks.count() // SPREAD))
    asked = stored(asked.withColumn("dim", F.size("vector")))
    parts = max(1, -(-asked.count() // QUERIES))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")).applyInArrow(
        _pack_queries, "dim int, part long, q_ids binary, q_vectors binary")
    packed = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("block", F.crc32("ids")), F.lit(groups)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = dealt.join(packed, ["dim", "group", "part"]).select(
        "dim", "n", "ids", "vectors", "codes", "sizes", "cosines", "q_ids", "q_vectors").mapInArrow(_search(k, means, width), _FOUND)
    return ranked(found, k)


def _pack_queries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = np.asarray(table.column("vec_id"))
    matrix = np.array(table.column("vector").to_pylist(), np.float64)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                     "q_ids": pa.array([ids.tobytes()]), "q_vectors": pa.array([matrix.tobytes()])})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query by score, then id. Spark keeps ``k`` per query and task before it shuffles."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
