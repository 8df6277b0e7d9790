import glob
import os
import random

import duckdb
import pytest

from sawlog.llm import archive, neighbours, quotations, toxicity
from sawlog.llm.common import folder
from sawlog.llm.queries import ORACLE, QUERIES
from tests.llm import brute
from tests.llm.corpus import sentence

SF = "/root/testdata/sf0.001"


def labelled(spark, n=600, seed=4):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words, toxic = sentence(rng, rng.randint(20, 120)).split(), i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbo", "snarfy", "vexilation", "vexilant"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(n, None, None), (n + 1, "", ""), (None, "grumbo " * 5, ""), (n + 2, "GRUMBO!!! gr.umbo " * 4, "")]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels + [(1, None), (None, 1), (99999, 1)], "doc_id long, toxic int"))


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = labelled(spark)
    got = toxicity.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    import zlib

    right = total = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id < 600:
            total += 1
            right += r.predicted == (r.doc_id % 5 == 0)
    assert right / total > 0.97
    by = {r.doc_id: r for r in got}
    assert not by[600].predicted and not by[601].predicted and by[None].predicted and by[602].predicted


def test_toxicity_never_sees_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert sorted(toxicity.report(docs, labels).collect(), key=key) == sorted(toxicity.report(docs, turned).collect(), key=key)


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.report(docs, labels.filter("false")).collect()} == {0.0}
    assert toxicity.report(docs.filter("false"), labels).collect() == []


def test_features_of_batches_that_share_no_word(monkeypatch):
    import numpy as np
    import pyarrow as pa

    lexicon = {"grumbo": 2.0, "snarfy": 1.0}
    texts = ["grumbo one", "三四五六", "", "YOU snarfy", "x" * 9_000_000, "gr.umbo two", "one grumbo"]
    for cache in toxicity.CACHE, 3:
        monkeypatch.setattr(toxicity, "CACHE", cache)
        reader = toxicity.Reader(lexicon)
        for text in texts:
            assert np.array_equal(reader(pa.array([text])), toxicity.Reader(lexicon)(pa.array([text])))


PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, "ünï"), (4, "u\r\nX-Page-ID: 77\u2028X-Page-ID: 78", None), (5, "u5", ""), (5, "u5", ""), (None, "n", "<p>a</p>"), (None, "n", "alone"),
         (6, "long", "x" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, sha256 string")


def test_archive_report(spark):
    import base64
    import hashlib

    got = sorted((tuple(r) for r in archive.archive_report(pages(spark)).collect()), key=repr)
    first = {}
    for key, _, html in PAGES:
        body = (html or "").encode()
        if key is not None:
            first[body] = max(key, first.get(body, key))
    want = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        revisit = body in first and key != first[body]
        want.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[body] if revisit else None))
    assert got == sorted(want, key=repr)


def test_small_payloads_are_responses(spark):
    kinds = {r.page_id: r.record_type for r in archive.archive_report(pages(spark), least=9).collect()}
    assert set(kinds.values()) == {"response"}
    assert archive.archive_report(pages(spark, [])).collect() == []


def test_records_are_rebuilt_and_verified(spark):
    place = folder(spark)
    archive.write_archive(pages(spark), place)
    rebuilt = archive.records(spark, place).collect()
    assert len(rebuilt) == len(PAGES)
    assert spark.read.parquet(f"{place}/payloads").select("sha256").distinct().count() == 5
    for r in rebuilt:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n"
    broken = spark.read.parquet(f"{place}/payloads").selectExpr("sha256", "size", "CAST(concat(CAST(payload AS STRING), 'x') AS BINARY) AS payload")
    broken.write.parquet(f"{place}/bad/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        archive.read_payloads(spark, f"{place}/bad").select("payload").collect()


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in base[i % 12]]) for i in range(700)]
    rows += [(700, [0.0] * 24), (701, None), (702, [float("nan")] * 24), (703, [None] * 24), (704, [float("inf")] * 24), (None, [1.0] * 24), (800, [1.0, 2.0]), (900, [2.0, 1.0]),
             (5, rows[9][1]), (600, rows[600][1]), (1000, [])]
    rows += [(1001 + i, rows[100][1]) for i in range(30)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in neighbours.nearest(frame, frame.filter("vec_id % 100 = 0"), 10).collect())
    want = sorted(brute.nearest(rows, [(i, v) for i, v in rows if i is not None and i % 100 == 0], 10))
    hits = len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want})
    assert len(got) == len(want) and hits >= 0.99 * len(want)
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want) if a[:3] == b[:3])


def test_nearest_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(frame, frame).collect() == []


MESSAGES = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\n> How  are YOU?\nFine thanks."), (1, 2, "user", "A new question arises"),
    (1, 3, "assistant", "On Tue, X wrote:\n> Fine thanks.\n>> hello there\nGood."), (1, 4, "user", "> A new question arises\nanswer"), (1, 5, None, None),
    (None, 1, "u", "> answer"), (1, 6, "u", "> nowhere to be found\nok"), (2, 0, "u", "> Good.\nx"), (2, 0, "u", "> Good.\nx"), (1, None, "u", "text"),
    (1, 7, "u", "> > > Good.\nlast"),
]


def test_quotations(spark):
    frame = spark.createDataFrame([(*m, "z") for m in MESSAGES], "conv_id long, turn long, role string, text string, tag string")
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.thread, r.depth, r.n_quotes, r.n_linked) for r in quotations.linked(frame).collect()}
    assert quotations.linked(frame).count() == len(MESSAGES)
    assert got[(1, 1)] == ("Fine thanks.", 0, 0, 1, 1, 1)
    assert got[(1, 3)] == ("Good.", 1, 0, 2, 2, 2)
    assert got[(1, 4)] == ("answer", 2, 2, 1, 1, 1)
    assert got[(1, 5)] == ("", None, 5, 0, 0, 0)
    assert got[(1, 6)] == ("ok", None, 6, 0, 1, 0)
    assert got[(1, 7)] == ("last", 3, 0, 3, 1, 1)
    assert got[(2, 0)] == ("x", None, 0, 0, 1, 0)
    assert got[(None, 1)] == ("", None, 1, 0, 1, 0)
    chats = [r.chat for r in quotations.chat(quotations.linked(frame).filter("conv_id = 1 AND thread = 0")).collect()]
    assert chats[1] == "<|assistant|>\nFine thanks.\n<|end|>" and len(chats) == 4


def test_quotations_equal_sql(spark):
    chain = [(9, i, "u", f"> > passage number {i - 2} here\n> passage number {i - 1} here\npassage number {i} here\n\n\n\nmore") for i in range(12)]
    rows = [m for m in MESSAGES if m != (2, 0, "u", "> Good.\nx")] + chain
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    duck = duckdb.connect()
    duck.register("conversations", frame.toArrow())
    result = duck.execute(ORACLE["op7_quotation_linking"])
    columns = [c[0] for c in result.description]
    got = sorted((tuple(r[c] for c in columns) for r in quotations.linked(frame).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "message number 0 of the chain")]
    rows += [(1, i, "u", f"> message number {i - 1} of the chain\nmessage number {i} of the chain") for i in range(1, 40)]
    got = quotations.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.turn, r.depth, r.thread) for r in got} == {(i, i, 0) for i in range(40)}
    assert quotations.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    got = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in QUERIES[name](spark, SF).collect()), key=repr)
    assert got == sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in result.fetchall()), key=repr)
