import json
import os
import random

import pytest

from sawlog.sinks.answers import AnswerError, read_answer
from sawlog.sinks.delivery import DeliveryError, deliver, documents_of, read_spool, send_bodies


def body_of(n):
    return "".join(f'{{"index":{{"_id":"{i}"}}}}\n{{"message":"m{i}"}}\n' for i in range(n))


def answer_of(statuses, **more):
    """A bulk answer with a long reason per failed item."""
    items = [{"index": {"status": s, "_id": str(i)} | ({"error": {"type": "t", "reason": "because, \"so\" ]}" * 8}} if s >= 400 else {})} for i, s in enumerate(statuses)]
    return json.dumps({"took": 3, "errors": any(s >= 400 for s in statuses)} | more | {"items": items, "end": [{"a": "}"}]}).encode()


def in_pieces(data, seed, most=50):
    rng, at = random.Random(seed), 0
    while at < len(data):
        step = rng.randint(1, most)
        yield data[at : at + step]
        at += step


def test_an_answer_is_read_in_any_pieces():
    statuses = [201, 429, 200, 400, 503] * 20
    whole = answer_of(statuses, ünï=[1.5, None, "é\u00e9", {"x": [[]]}])
    want = {i: s for i, s in enumerate(statuses) if s >= 400}
    for seed in range(30):
        got = read_answer(in_pieces(whole, seed, 1 + seed))
        assert got.errors and got.items == 100 and {k: s for k, (s, _) in got.failed.items()} == want
        assert got.again() == [i for i, s in enumerate(statuses) if s in (429, 503)] and set(got.refused()) == {i for i, s in enumerate(statuses) if s == 400}
    # Any cut is told.
    for cut in range(1, len(whole), 97):
        with pytest.raises(AnswerError):
            read_answer(in_pieces(whole[:cut], cut))


@pytest.mark.parametrize("answer", [b"", b"  \n", b"{}", b'{"errors":false,"items":[]}', b'{"items":[],"errors":false}\n'])
def test_answers_without_failures(answer):
    told = read_answer([answer])
    assert not told.errors and not told.failed


@pytest.mark.parametrize("answer", [b"[]", b"1", b"x", b'{"items":[{"index":1}]}', b'{"items":[1]}', b'{"a":1,}', b'{"a":1}}', b'{1:2}', b"\xff{}", b'{"a" 1}'])
def test_answers_that_are_not_whole_objects(answer):
    with pytest.raises(AnswerError):
        read_answer([answer])


def test_all_failed_documents_of_a_long_answer_are_sent_again():
    """6,000 documents fail in an answer of over a megabyte; a mebibyte of it would not tell."""
    sent, n = [], 6_000

    def send(body_id, body, attempt):
        sent.append(documents_of(body))
        statuses = [503] * n if attempt == 0 else [201] * len(sent[-1])
        data = answer_of(statuses)
        assert attempt or len(data) > 1 << 20
        return read_answer(in_pieces(data, 1, 1 << 16))

    deliver(send, "id", body_of(n), 3, sleep=lambda s: None)
    assert [len(s) for s in sent] == [n, n] and sent[0] == sent[1]


def test_only_failed_documents_are_sent_again_and_refused_ones_are_told():
    sent = []
    answers = [[201, 429, 400, 503, 201], [201, 429], [201]]

    def send(body_id, body, attempt):
        sent.append([json.loads(d.split("\n")[0])["index"]["_id"] for d in documents_of(body)])
        return read_answer([answer_of(answers[attempt])])

    with pytest.raises(DeliveryError, match="1 documents were refused .document 2: 400"):
        deliver(send, "id", body_of(5), 5, sleep=lambda s: None)
    assert sent == [["0", "1", "2", "3", "4"], ["1", "3"], ["3"]]
    sent.clear()
    with pytest.raises(DeliveryError, match="after 2 tries: 1 documents failed .document 3: 429"):
        deliver(send, "id", body_of(5), 2, sleep=lambda s: None)


def test_an_answer_for_other_documents_is_a_failure():
    with pytest.raises(DeliveryError, match="3 items for 5 documents"):
        deliver(lambda *_: read_answer([answer_of([201, 503, 201])]), "id", body_of(5), 1, sleep=lambda s: None)


def test_replayed_answers_through_spark(spark, tmp_path):
    answers = tmp_path / "answers"
    answers.mkdir()
    n = 6_000
    (answers / "one.0").write_bytes(answer_of([503 if i % 2 else 201 for i in range(n)]))
    (answers / "one.1").write_bytes(answer_of([201] * (n // 2)))
    (answers / "two.0").write_bytes(answer_of([201]))
    bodies = spark.createDataFrame([("one", body_of(n)), ("two", body_of(1)), ("three", body_of(2))], "id string, body string")
    place = {"transport": "replay", "path": str(tmp_path / "sent"), "answers": str(answers)}
    send_bodies(bodies, place, tries=3)
    assert sorted(os.listdir(tmp_path / "sent")) == ["one.0", "one.1", "three.0", "two.0"]
    again = documents_of((tmp_path / "sent" / "one.1").read_text())
    assert again == documents_of(body_of(n))[1::2]
    (answers / "two.0").write_bytes(answer_of([400]))
    with pytest.raises(Exception, match="refused"):
        send_bodies(bodies, place, tries=3)


def test_spooled_bodies_are_a_file_a_task(spark, tmp_path):
    """A thousand bodies in four files, whatever they hold; what is sent again counts once, and a failed write shows nothing."""
    place = {"transport": "spool", "path": str(tmp_path / "s")}
    rows = [(f"id-{i}", f'{{"m":"ü \\ \n {i}"}}\r\n\u2028') for i in range(1_000)]
    bodies = spark.createDataFrame(rows, "id string, body string").repartition(4)
    send_bodies(bodies, place)
    assert 1 <= len(os.listdir(tmp_path / "s")) <= 4
    send_bodies(bodies.where("id LIKE '%7'"), place)
    assert sorted(tuple(r) for r in read_spool(spark, str(tmp_path / "s")).collect()) == sorted(rows)
    bad = {"transport": "spool", "path": str(tmp_path / "t")}
    with pytest.raises(Exception, match="not a text"):
        send_bodies(spark.createDataFrame([("a", "1"), ("b", None)], "id string, body string").coalesce(1), bad)
    assert all(name.startswith(".") for name in os.listdir(tmp_path / "t"))
