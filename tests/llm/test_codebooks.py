import random

import numpy as np
import pytest

from sawlog.llm import codebooks as c

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, comps int, known string, name string"


def brute(rows, positions, entries, rounds):
    """(vec_id, code, error) of usable rows, and the books, by plain loops."""
    kept = [(k, [int(np.floor(float(np.float32(x)) * 256)) for x in v], label) for k, v, label in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    size = width // positions
    books = [[r[1][m * size : (m + 1) * size] for r in order[:entries]] for m in range(positions)]

    def near(m, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[m]))

    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, v, _ in kept:
            for m in range(positions):
                part = v[m * size : (m + 1) * size]
                held[m][near(m, part)[1]].append(part)
        books = [[[sum(x) // len(parts) for x in zip(*parts, strict=True)] if parts else entry for parts, entry in zip(of, book, strict=True)]
                 for of, book in zip(held, books, strict=True)]
    out = []
    for k, v, label in kept:
        told = [near(m, v[m * size : (m + 1) * size]) for m in range(positions)]
        out.append((k, label, "".join(f"{e:02x}" for _, e in told), sum(d for d, _ in told)))
    return out, books


def vectors(n=300, width=8, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)], rng.choice([1, 2, None])) for i in range(5, n)]
    rows += [(n + i, [0.25] * width, 1) for i in range(n // 2)]  # a third of all rows are copies
    rows += [(1, None, 1), (2, [], 2), (3, [None] * width, 1), (4, [float("nan")] * width, 1), (0, [float("inf")] * width, 3), (None, [1.0] * width, 7)]
    rows += [(7, [0.5] * width, 1), rows[0], rows[0], (n * 9, [1.0] * (2 * width), 1), (n * 10, [-0.0] * width, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("positions,entries,rounds,owner", [(4, 16, 2, 50), (2, 7, 5, 200_000), (8, 3, 0, 100), (1, 64, 1, 9)])
def test_vector_codes(spark, positions, entries, rounds, owner):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA).repartition(3)
    got, books = c.compressed(df, positions, entries, rounds, owner)
    want, want_books = brute(rows, positions, entries, rounds)
    assert books.tolist() == want_books
    assert sorted((tuple(r) for r in got.select("vec_id", "label", "code", "error").collect()), key=repr) == sorted(want, key=repr)


def test_report(spark):
    rows = vectors(60)
    got = c.report(spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA), 4, 16, 2).collect()
    want, _ = brute(rows, 4, 16, 2)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(
        ((k, code, error, totals[label]) for k, label, code, error in want), key=repr)
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_only_parts_that_change_their_entry_move(spark):
    rows = c.stored(c.whole(spark.createDataFrame([r for r in vectors()], "vec_id long, embedding array<float>, label int")).filter("size(comps) = 8"))
    books = np.array(c.seeds(rows, 16), np.int64).reshape(16, 4, 2).transpose(1, 0, 2)
    held = c.stored(c.to_owners(c.members(rows, books), 6, 3))
    told = c.reassigned(held, c.updated(held, books))
    assert "Exchange" not in told._jdf.queryExecution().toString()
    moved = told.filter("entry <> home").count()
    assert 0 < moved < told.count() // 2
    # The owner of an entry with a third of all rows is several, by salt.
    most = held.groupBy("position", "entry").count().orderBy("count", ascending=False).first()
    hot = held.filter(f"position = {most.position} AND entry = {most.entry}")
    assert hot.selectExpr("spark_partition_id() AS p").distinct().count() > 1 or hot.selectExpr("pmod(salt, 3) AS s").distinct().count() == 3


def test_empty_short_and_wrong_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert c.report(spark.createDataFrame([], schema)).collect() == []
    assert c.report(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 16, 2)], schema)).collect() == []
    one = c.report(spark.createDataFrame([(1, [0.5] * 16, None)], schema)).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 16, 0, 0)]
    with pytest.raises(ValueError, match="do not divide"):
        c.report(spark.createDataFrame([(1, [0.5] * 10, 1)], schema))
    with pytest.raises(Exception, match="no exact code"):
        c.report(spark.createDataFrame([(1, [1e30] * 16, 1)], schema)).collect()


def test_large_components_are_exact():
    rng = np.random.default_rng(3)
    parts = rng.integers(-(2**26) + 1, 2**26, (40, 4))
    entries = rng.integers(-(2**26) + 1, 2**26, (9, 4))
    best, far = c.nearest(parts, entries)
    for part, b, f in zip(parts.tolist(), best, far, strict=True):
        exact = [sum((x - y) ** 2 for x, y in zip(part, entry, strict=True)) for entry in entries.tolist()]
        assert f == min(exact) and b == exact.index(min(exact))
