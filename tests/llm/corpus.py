"""Small tables with awkward rows."""

import random

SYLLABLES = "ba de ki lo mu na pe ri so tu va wen xi yor zat".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=40):
    """(doc_id, text): plain, copied, nearly copied, overlapping, periodic, empty, null, and very long texts."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(3, 160)) for _ in range(n)]
    passage = sentence(rng, 70)
    out = list(texts)
    out += [texts[0], texts[1], texts[1].upper(), texts[2] + " \t" + "tail"]
    for t in texts[:12]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(6)]
    out += ["be " * 300, "be " * 250 + "end", "", None, "   \n\t ", "one", "é" * 500, "é" * 450 + "x", "Ünï çödé " * 60]
    long = sentence(rng, 30_000)
    out += [long, sentence(rng, 50) + " " + long[5_000:9_000]]
    rows = list(enumerate(out, 100))
    rng.shuffle(rows)
    rows += [rows[0], rows[0], (None, texts[3]), (None, None), (rows[1][0], texts[4])]
    return rows


CLASHING = "doc_id long, text string, id string, tag string, digest string, spans int, score double, held boolean, hits int, n_chars long, `a b` string, _tox int"


def documents(spark, rows):
    """The rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x", None, "y", 1, 0.5, True, 3, len(t or ""), None, 4) for k, t in rows], CLASHING)
