import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sawlog.llm import mixing as m
from sawlog.llm.common import Words
from tests.llm.corpus import corpus, documents, sentence


def lower(text):
    return (text or "").encode().translate(m._LOWER)


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(text))


def fold(k):
    return None if k is None else zlib.crc32(str(k).encode()) % 10


def base(rows):
    """What the contract says of the plain columns, by counting."""
    seen, texts = Counter(), 0
    for k, text in rows:
        if fold(k):
            seen.update(tokens(text))
            texts += 1
    n, v = sum(seen.values()) + texts, len(seen) + (texts > 0)
    out = []
    for k, text in rows:
        counts = [*(seen[w] for w in tokens(text)), texts]
        out.append((k, fold(k) == 0, len(counts), sum(c > 0 for c in counts), n, sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts)))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], r[3], r[5])


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(m, "CODED", 300)  # so that many words have no code of their own
        got = m.report(documents(spark, rows).repartition(3)).collect()
    return rows, got


def test_plain_columns(scored):
    rows, got = scored
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(have, sorted(base(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_scores_are_log_probabilities(scored):
    _, got = scored
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
    same = {}
    for r in got:
        same.setdefault((r.n_bytes, r.n_tokens, round(r.base_score, 6)), set()).add(r.score)
    assert all(len(scores) == 1 for scores in same.values())  # equal texts, equal scores


def test_held_out_texts_are_told_better_than_by_word_counts(spark):
    rng = random.Random(8)
    names = [sentence(rng, 1) for _ in range(60)]
    follow = {w: rng.sample(names, 3) for w in names}

    def text(n):
        out = [rng.choice(names)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(k, text(rng.randint(20, 120))) for k in range(400)]
    rows += [(1000 + k, " ".join(rng.choice(names) for _ in range(60))) for k in range(200) if fold(1000 + k) == 0]
    got = {r.doc_id: r for r in m.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 1000]
    noise = [r for r in got.values() if r.doc_id >= 1000]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)
    per = [sum(r.score for r in some) / sum(r.n_tokens for r in some) for some in (held, noise)]
    assert per[0] > per[1] + 0.3  # the order of words counts


def bits(of):
    """Bits of the symbols and their slots, bit by bit, and how many bits each symbol has."""
    bit, slots = [], []
    places, _, count = m.steps(of)
    step = 0
    for value, n, steps in zip(of.value.tolist(), of.length.tolist(), count.tolist(), strict=True):
        text = format(value, f"0{n}b")
        for i, b in enumerate(text):
            bit.append(b == "1")
            slots.append(places[:, step + i // 4] * 16 + int("1" + text[i // 4 * 4 : i], 2))
        step += steps
    return np.array(bit, bool), np.array(slots).reshape(-1, m.CONTEXTS).T, of.length


def model(texts, coded=40):
    counts = Counter(h for t in texts for h in Words([lower(t)]).hash.tolist())
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:coded]
    code = m.code_of(np.array([a for a, _ in top], np.uint64), np.array([b for _, b in top]), len(texts), 5)
    table = np.zeros(2 * m.SLOTS, np.int64)
    for t in texts:
        of, _ = m.symbols(Words([lower(t)]), code, np.zeros((1, 2), np.uint64), True)
        bit, slots, _ = bits(of)
        np.add.at(table, (slots.astype(np.int64) * 2 + bit).reshape(-1), 1)
    return m.start(code, m.predictions(table.reshape(-1, 2)))


def plainly(model, text):
    """The same score, bit by bit."""
    of, _ = m.symbols(Words([lower(text)]), model.code, np.zeros((1, 2), np.uint64), True)
    bit, slots, _ = bits(of)
    own, refined, score = np.zeros(m.CONTEXTS), model.refined.astype(float), 0.0
    for a in range(0, len(bit), m.BLOCK):
        slope, seen = np.zeros(m.CONTEXTS), np.zeros((m.BUCKETS, 2))
        for i in range(a, min(a + m.BLOCK, len(bit))):
            said = [int(model.table[s]) for s in slots[:, i]]
            x = np.array([(t >> 2) / 1024 for t in said])
            gate = (said[1] & 3) * 4 + (said[2] & 3)
            dot = min(max(float((model.weights[gate] + own) @ x), -m.LIMIT + 0.01), m.LIMIT - 0.01)
            chance, bucket = 1 / (1 + math.exp(-dot)), int((dot + m.LIMIT) * m.BUCKETS / (2 * m.LIMIT))
            final = (chance + refined[bucket]) / 2
            score += math.log(final if bit[i] else 1 - final)
            slope += (bit[i] - chance) * x
            seen[bucket, int(bit[i])] += 1
        own = own + m.RATE * slope
        refined = (refined * m.INERTIA + seen[:, 1]) / (m.INERTIA + seen.sum(axis=1))
    return score


def test_side_by_side_equals_bit_by_bit():
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(1, 300)) for _ in range(30)] + ["", "x", "Ünï çödé " * 30, "q" * 700]
    by = model(texts[:20])
    told = m.tell(by, [lower(t) for t in texts])
    for text, score in zip(texts, told.state.score, strict=True):
        assert score == pytest.approx(plainly(by, text), rel=2e-4)


def test_outcomes_of_steps_hold_the_counts_of_all_nodes():
    rng = random.Random(9)
    texts = [lower(sentence(rng, 120)) for _ in range(12)] + [b"", lower("Ünï çödé" * 9)]
    by = model([sentence(rng, 120) for _ in range(6)])
    of, _ = m.symbols(Words(texts), by.code, np.zeros((len(texts), 2), np.uint64), True)
    bit, slots, length = bits(of)
    own, said = m.said(by.table, of)
    assert (own == bit).all() and (said == by.table[slots]).all()
    places, outcome, count = m.steps(of)
    assert len(bit) == of.length.sum() and count.tolist() == [-(-n // m.STEP) for n in of.length.tolist()]
    # Bits of a symbol, put together again, are its code.
    ends = np.cumsum(length)
    assert [int("".join(str(int(b)) for b in bit[e - n : e]), 2) for e, n in zip(ends, length, strict=True)] == of.value.tolist()
    for k in range(m.CONTEXTS):
        by_bit, by_step = np.zeros((m.SLOTS, 2), np.int64), np.zeros((m.SLOTS // m.SIDE, m.OUTCOMES), np.int64)
        np.add.at(by_bit, (slots[k], bit.astype(int)), 1)
        np.add.at(by_step, (places[k], outcome), 1)
        assert (m.by_node(by_step) == by_bit).all()


def test_probabilities_of_all_next_tokens_sum_to_one(monkeypatch):
    """Every bit is told from earlier ones only: the code is a full tree, so both ways at each node sum to one."""
    rng = random.Random(6)
    by = model([sentence(rng, 80) for _ in range(8)], coded=12)
    for value, length in ((by.code.value, by.code.length), m.SPELLING):
        assert sum(0.5 ** int(n) for n in length) == pytest.approx(1)
        texts = {format(int(v), f"0{int(n)}b") for v, n in zip(value, length, strict=True)}
        assert len(texts) == len(value) and not any(a != b and b.startswith(a) for a in texts for b in texts)
    start = Words([b"ba de ki"])
    of, _ = m.symbols(start, by.code, np.zeros((1, 2), np.uint64), False)
    bit, slots, _ = bits(of)
    total = 0.0
    # All codes of one more token, scored after the same beginning.
    for i in range(len(by.code.value)):
        more = m.Symbols(by.code.value[i : i + 1], by.code.length[i : i + 1], of.contexts[:, -1:], np.zeros(1, np.int64), np.array([i]))
        b, s, _ = bits(more)
        both, alone = m.State.of(by, 1), m.State.of(by, 1)
        m.follow(by, np.append(bit, b), by.table[np.concatenate([slots, s], axis=1)], np.array([len(bit) + len(b)]), both)
        m.follow(by, bit, by.table[slots], np.array([len(bit)]), alone)
        total += math.exp(both.score[0] - alone.score[0])
    assert total == pytest.approx(1, rel=1e-4)


def test_long_texts_are_read_in_stretches(monkeypatch):
    rng = random.Random(4)
    by = model([sentence(rng, 200) for _ in range(5)])
    texts = [lower(sentence(rng, 900)), lower(sentence(rng, 3)), b"z" * 5000, b"", lower(sentence(rng, 500)) + b" "]
    whole = m.tell(by, texts)
    monkeypatch.setattr(m, "LONG", 700)
    monkeypatch.setattr(m, "CHUNK", 90)
    parts = m.tell(by, texts)
    assert parts.tokens.tolist() == whole.tokens.tolist() and parts.coded.tolist() == whole.coded.tolist()
    assert np.allclose(parts.base, whole.base)
    assert [r.tolist() for r in parts.rare] == [r.tolist() for r in whole.rare]
    # Blocks end elsewhere, so scores differ a little; the same bits are told.
    assert np.allclose(parts.state.score, whole.state.score, rtol=0.1)


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert m.report(spark.createDataFrame([], schema)).collect() == []
    held = next(k for k in range(100) if fold(k) == 0)
    got = m.report(spark.createDataFrame([(held, "a b"), (None, "a b"), (None, None)], schema)).collect()
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [
        (False, 1, 0, 0, 0.0), (False, 3, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert all(r.score < 0 for r in got)


def test_words_are_found_by_their_hashes(monkeypatch):
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2))
    words = np.unique(np.concatenate([words, words[:9] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
    for leading in (3, m.LEADING):
        monkeypatch.setattr(m, "LEADING", leading)
        code = m.code_of(words[::2], np.ones(len(words[::2]), np.int64), 1, 1)
        asked = np.concatenate([words, words[:50]])
        found, at = code.find(asked), {w: i for i, w in enumerate(words[::2].tolist())}
        assert found.tolist() == [at.get(w, code.end + 1) for w in asked.tolist()]
    assert m.code_of(words[:0], np.zeros(0, np.int64), 1, 1).find(words[:3]).tolist() == [1, 1, 1]
