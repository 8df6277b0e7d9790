"""Removal of byte strings that occur more than once in a corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import (
    KEY, Prefixes, intervals, keyed, narrow, rolling, sliding_min, stored, with_repeated,
)
from sawlog.llm.repeated_words import _batches, _lists

Q = 32  # bytes of the q-grams that make the first buckets
WIDTHS = (48, 1)  # start positions that one refinement settles together
SLICE = 1 << 18  # bytes that a task's arrays are made for at a time; a longer text or region stands alone
TEXTS, REGIONS = 256, 2_000  # rows that a task is handed together
_PLACE = np.uint64((1 << 31) - 1)


def _runs(texts: list[bytes], length: int):
    """Neighbouring strings of ``length`` bytes that share their anchor.

    The anchor of a string is the place of its smallest q-gram hash, the leftmost of equals; it depends on the string's
    bytes only, so equal strings have it at the same offset. Yields arrays, one entry per run: the text, first and last start, and the
    anchor, all as places in the joined bytes, and the anchor's q-gram.
    """
    data = b"".join(texts)
    grams = rolling(np.frombuffer(data, np.uint8), Q, 3)
    placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(placed, length - Q + 1) & _PLACE).astype(np.int64)
    size = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), size)
    n = len(anchor)
    at = np.flatnonzero(text[:n] == text[len(text) - n :])
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else first
    return data, np.cumsum(size) - size, text[first], first, last, anchor[first], grams[anchor[first]] if n else grams[:0]


def _scan(length: int):
    def run(batches):
        for batch in batches:
            for a, b, texts in _batches(batch, limit=SLICE):
                _, _, text, _, _, _, gram = _runs(texts, length)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("id", "tag", "digest", "doc_id")),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                     _lists(gram.view(np.int64), text, b - a, pa.int64())],
                    ["id", "tag", "digest", "doc_id", "n_bytes", "sha", "grams"])

    return run


_REGION = "id long, tag long, start long, low int, high int, region binary"


def _regions(length: int):
    """Runs whose q-gram is repeated, with the bytes that their strings cover together."""

    def run(batches):
        for batch in batches:
            hits = batch.column("hits")
            for a, _, texts in _batches(batch, limit=SLICE):
                data, base, text, first, last, anchor, gram = _runs(texts, length)
                keep = np.zeros(len(text), bool)
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    part = slice(bounds[i], bounds[i + 1])
                    keep[part] = np.isin(gram[part], np.array(hits[a + i].as_py(), np.int64).view(np.uint64))
                text, first, last, anchor = text[keep], first[keep], last[keep], anchor[keep]
                rows = pa.array(text + a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in KEY), pa.array(first - base[text], pa.int64()),
                     pa.array(anchor - last, pa.int32()), pa.array(anchor - first, pa.int32()),
                     pa.array([data[s : e + length] for s, e in zip(first, last, strict=True)], pa.binary())],
                    ["id", "tag", "start", "low", "high", "region"])

    return run


def _refined(length: int, width: int):
    """Hashes of parts of runs: the strings whose anchor lies ``low`` to ``high`` bytes after their start.

    Strings are taken ``width`` start positions at a time. All of a part's strings share a core of bytes, and together
    they cover a union: strings of different parts can be equal only if the cores are, and all are if the unions are.
    """

    def run(batches):
        for batch in batches:
            for a, b, regions in _batches(batch, "region", SLICE):
                low, high, top = (np.array(batch.column(c).slice(a, b - a)) for c in ("low", "high", "top"))
                size = np.array([len(r) for r in regions])
                anchor = np.cumsum(size) - size + top
                cells = high // width - low // width + 1
                row = np.repeat(np.arange(b - a), cells)
                cell = low[row] // width + np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
                lo, hi = np.maximum(low[row], cell * width), np.minimum(high[row], cell * width + width - 1)
                prefix = Prefixes(b"".join(regions))
                core = prefix.spans(anchor[row] - cell * width, anchor[row] + length - (cell * width + width - 1), cell + 1)
                union = prefix.spans(anchor[row] - hi, anchor[row] + length - lo, (lo + 1) * 4096 + hi)
                rows = pa.array(row + a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("id", "tag", "start")), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()),
                     pa.array((batch.column("top").take(rows)).to_numpy(zero_copy_only=False), pa.int32()),
                     pa.array(core.view(np.int64)), pa.array(union.view(np.int64))],
                    ["id", "tag", "start", "low", "high", "top", "core", "union"])

    return run


_PART = "id long, tag long, start long, low int, high int, top int, core long, union long"
RUN = [*KEY, "start"]


def _found(parts: DataFrame) -> DataFrame:
    """Starts of repeated strings, as spans: ``first`` to ``last``."""
    return parts.select(*KEY, (F.col("start") + F.col("top") - F.col("high")).alias("first"),
                        (F.col("start") + F.col("top") - F.col("low")).alias("last"))


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The scan (a row per text) and, per key, spans of starts of repeated strings; ``docs`` is from ``keyed``."""
    scan = stored(docs.mapInArrow(_scan(length), "id long, tag long, digest string, doc_id long, n_bytes long, sha string, grams array<long>"), TEXTS)
    copied = stored(scan.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("id", "tag")).alias("rep")).filter("copies > 1"))
    flagged = scan.join(narrow(copied), "digest", "left").withColumn("copy", F.col("copies").isNotNull())
    own = flagged.filter(~F.col("copy") | (F.struct("id", "tag") == F.col("rep"))).select(*KEY, "grams")
    # First buckets: q-grams at anchors; those with one member drop out.
    repeated = stored(own.select(F.explode("grams").alias("gram")).groupBy("gram").count().filter("count > 1").select("gram"))
    texts = docs.select(*KEY, "text")
    regions = stored(with_repeated(texts, own, repeated).mapInArrow(_regions(length), _REGION), TEXTS)
    pending = regions.withColumn("top", F.col("high"))
    found = None
    for width in [w for w in WIDTHS if 2 * w <= length]:
        parts = stored(pending.select(*RUN, "low", "high", "top", "region").mapInArrow(_refined(length, width), _PART), REGIONS)
        classes = stored(parts.groupBy("core", "union").agg(
            F.count("*").alias("n"), F.min(F.struct(*RUN, "low", "high", "top")).alias("rep")))
        equal = classes.filter("n > 1").select("core", "union")
        settled = stored(_found(parts.join(equal, ["core", "union"])))
        found = settled if found is None else found.unionByName(settled)
        if width > 1:
            # Buckets with several different unions go on: one member of each.
            mixed_cores = classes.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1").select("core")
            ahead = stored(classes.join(mixed_cores, "core", "left_semi").select("rep.*"))
            pending = regions.drop("low", "high").join(ahead, RUN)
    # Neighbouring starts meet again in one list per text.
    return flagged, stored(found.groupBy(KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans")))


def _cut(length: int):
    def run(batches):
        for batch in batches:
            spans = batch.column("spans")
            for a, b, texts in _batches(batch, limit=SLICE):
                out = []
                for i, text in enumerate(texts, a):
                    at = np.array([(s["first"], s["last"]) for s in spans[i].as_py()], np.int64)
                    kept, before, removed = [], 0, 0
                    first, end = intervals(at[:, 0], at[:, 1] + length)
                    for s, e in zip(first, end, strict=True):
                        kept.append(text[before:s])
                        before, removed = e, removed + int(e - s)
                    out.append((removed, len(first), b"".join([*kept, text[before:]])))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in KEY), *(pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)),
                     pa.array([o[2] for o in out], pa.binary())], [*KEY, "n_removed", "n_spans", "kept"])

    return run


def repeated_bytes(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """Bytes covered by a string of ``length`` bytes that also starts anywhere else in the corpus.

    Returns two frames. ``scan``: a row per row of ``docs(doc_id, text)`` with its key, ``n_bytes``, ``sha`` (SHA-256 of its UTF-8
    bytes) and ``copy`` (another row has the same text, so all of it goes if it has ``length`` bytes). ``cut``: for the other texts
    that lose bytes, ``n_removed``, ``n_spans`` and the ``kept`` bytes. Only these two columns are read; a null text is
    empty; rows without ``doc_id`` are texts like others; strings never cross texts.

    Hashed spans, in place of bucket-pointer refinement: strings are grouped by the q-gram at their anchor, and singletons drop out.
    Then two fixed rounds group them by Rabin-Karp hashes of their raw bytes, of several start positions at once and then of each whole
    string; no suffix is sorted and no earlier bucket looked up. A round drops what stands alone, settles what is equal, and passes
    one member of each remaining group on to the finer round. Parts are counted with
    pre-aggregation, so a passage in a third of all documents is no task's burden. Identifiers have 64 bits.
    """
    if length < Q:
        raise ValueError(f"strings need at least {Q} bytes")
    docs = keyed(docs)
    scan, spans = repeated_spans(docs, length)
    rest = scan.filter(~F.col("copy")).select(KEY)
    wanted = stored(spans.join(rest, KEY, "left_semi"))
    texts = docs.select(*KEY, "text").join(narrow(wanted.select(KEY)), KEY, "left_semi")
    cut = texts.join(wanted, KEY).mapInArrow(_cut(length), "id long, tag long, n_removed long, n_spans long, kept binary")
    return scan.select(*KEY, "doc_id", "n_bytes", "sha", "copy"), cut


def removal_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``: see ``repeated_bytes``."""
    scan, cut = repeated_bytes(docs, length)
    cut = stored(cut.select(*KEY, "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).dropDuplicates(KEY), TEXTS)
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    return scan.join(narrow(cut), KEY, "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
