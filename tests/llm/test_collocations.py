import random
import re
from collections import Counter

import numpy as np
import pytest

from sawlog.llm import collocations as c
from tests.llm.corpus import documents, sentence


def brute(rows, threshold, top, percent, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= threshold and len(key[1]) > 1}
    covered = {}
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = lang, words[i : i + k]
                covered[part] = max(covered.get(part, 0), a)
    out = []
    for lang in {key[0] for key in found}:
        scored = []
        for (of, words), a in found.items():
            if of == lang and 100 * covered.get((of, words), 0) < percent * a:
                cuts = [(2_000_000 * a // (f[of, words[:k]] + f[of, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(words).encode(), f[of, words[:k]], f[of, words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows(seed=3):
    rng = random.Random(seed)
    words = sentence(rng, 30).split()
    out = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", "!? "]) for _ in range(rng.randint(1, 60)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), text.upper() if i % 7 == 0 else text))
    out += [("en", None), ("en", ""), (None, " \t\n"), ("", "ba ba ba ba"), ("x", "en de en de en de en de"), ("en", "x de x de x de"), ("Ünï", "é ü é ü é ü é ü é ü")]
    out += [("long", " ".join(rng.choice(words[:9]) for _ in range(30_000))), ("long", "q" * 5000 + " " + "r" * 9000 + " r")]
    return out + out[:20] * 2


@pytest.mark.parametrize("threshold,top,limit,part", [(3, 2000, 4 << 20, 4_000_000), (4, 25, 200, 900), (30, 7, 17, 500)])
def test_collocations(spark, threshold, top, limit, part, monkeypatch):
    monkeypatch.setattr(c, "TOP_ROWS", 40)
    table = rows()
    docs = spark.createDataFrame([(lang, text, 1, "x", 2, 3) for lang, text in table], "lang string, text string, k int, phrase string, f int, rank int")
    got = c.collocations(docs.repartition(3), threshold, top, 80, part=part, limit=limit)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(table, threshold, top, 80)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert c.collocations(documents(spark, [(1, None), (2, "")]).withColumnRenamed("id", "lang")).collect() == []


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(4)
    for threshold in (2, 5, 30):
        stream = np.concatenate([np.repeat(rng.integers(0, 50, 40), threshold), rng.integers(50, 2**32, 20_000)]).astype(np.uint32)
        rng.shuffle(stream)
        summary = c.Summary(len(stream) // threshold + 1)
        other = c.Summary(len(stream) // threshold + 1)
        for i, some in enumerate(np.array_split(stream, 40)):
            (summary if i % 2 else other).merge(*np.unique(some, return_counts=True))
        summary.lowered += other.lowered
        summary.merge(other.keys, other.counts)
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= threshold].tolist()) <= set(summary.at_least(threshold).tolist())
        assert summary.lowered < threshold
        assert len(summary.keys) <= summary.capacity


def test_products_beyond_64_bits(spark):
    a = 2**62
    counts = spark.createDataFrame([("en", 2, "a b", a), ("en", 1, "a", a + 5), ("en", 1, "b", 2**63 - 1)], "lang string, k int, phrase string, f long")
    assert c.scored(counts).first().score == 2_000_000 * a // (a + 5 + 2**63 - 1)


def test_a_word_and_a_language_may_exchange_names(spark):
    table = [("es", "en de " * 8), ("en", "es de " * 5), ("de", "en es " * 9)]
    got = c.collocations(spark.createDataFrame(table, "lang string, text string"), 3, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute(table, 3, 100, 80)
