"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    words = SPACE_WORDS.findall(lowered(text))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def groups(docs, width, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = defaultdict(list)
    for key, text in docs:
        if key is not None:
            sets[key].append(shingles(text, width))
    flat = [(k, s) for k, many in sets.items() for s in many]
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def without_repeated_words(docs, width):
    words = [(k, SPACE_WORDS.findall(t or "")) for k, t in docs]
    first = {}
    for key, ws in sorted(((k, w) for k, w in words if k is not None), key=lambda x: x[0]):
        for i in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[i:i + width]), key)
    out = []
    for key, ws in words:
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if key is not None and first[tuple(ws[i:i + width])] < key:
                gone[i:i + width] = [True] * width
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((key, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def without_repeated_bytes(docs, length):
    texts = [(k, (t or "").encode()) for k, t in docs]
    count = defaultdict(int)
    for _, b in texts:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = []
    for key, b in texts:
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                start = max(i, end)
                gone[start:i + length] = b"\1" * (i + length - start)
                end = i + length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key, len(b), sum(gone), sum(1 for run in bytes(gone).split(b"\0") if run), hashlib.sha256(kept).hexdigest()))
    return out


def contaminated(docs, items, length):
    grams = defaultdict(set)
    for item, text in items:
        words = ALNUM_WORDS.findall(lowered(text))
        n = min(len(words), length)
        for i in range(len(words) - n + 1 if n else 0):
            grams[tuple(words[i:i + n])].add(item)
    out = []
    for key, text in docs:
        words, hit, found = ALNUM_WORDS.findall(lowered(text)), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(words) - n + 1):
                if (g := tuple(words[i:i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((key, len(words), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    text = text or ""
    return sorted([(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
                  + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def pieces(tokenizer, text, length, end):
    import numpy as np

    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
    return [(k, k * length, len(part := ids[k * length:(k + 1) * length]), zlib.crc32(part.tobytes())) for k in range(-(-len(ids) // length))]


def nearest(rows, queries, k):
    import math

    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = [(i, v) for i, v in rows if i is not None and fine(v)]
    vectors = {}
    for i, v in queries:
        if i is not None and fine(v):
            vectors[i] = min(vectors.get(i, v), v)
    out = []
    for q, v in vectors.items():
        best = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                d = math.sqrt(sum((a - b) ** 2 for a, b in zip(w, v)))
                best[i] = min(best.get(i, d), d)
        out += [(q, r, i, d) for r, (i, d) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:k], 1)]
    return out
