"""Removal of word windows that an earlier document has too."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import (
    KEY, Words, intervals, keyed, narrow, pieces, rolling, sliding_min, stored, with_repeated,
)

GRAM = 6  # words of the grams that thin out the windows


def _batches(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20):
    """Ranges of neighbouring texts with about ``limit`` bytes together, and their bytes; no others are copied out of the batch."""
    texts = batch.column(column)
    for a, b in pieces(pc.binary_length(texts).to_pylist(), limit):
        yield a, b, texts.slice(a, b - a).cast(pa.binary()).to_pylist()


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window within one text: its smallest gram, its text, and its first word in the text."""
    small = sliding_min(rolling(words.hash, min(GRAM, width)), width - min(GRAM, width) + 1)
    n = len(small)
    inside = words.text[:n] == words.text[len(words.text) - n :]
    at = np.flatnonzero(inside)
    text = words.text[at]
    return small[at], text, at - words.first[text]


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values grouped by their sorted owner numbers, as one list each."""
    offsets = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _scan(width: int):
    def run(batches):
        for batch in batches:
            for a, b, texts in _batches(batch):
                words = Words(texts)
                small, text, _ = _windows(words, width)
                new = np.ones(len(small), bool)
                new[1:] = (small[1:] != small[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("id", "tag", "digest", "doc_id")),
                     pa.array(words.count, pa.int64()), pa.array([_sha(b" ".join(t.split())) for t in texts]),
                     _lists(small[new].view(np.int64), text[new], b - a, pa.int64())],
                    ["id", "tag", "digest", "doc_id", "n_words", "sha", "grams"])

    return run


def _candidates(width: int):
    """Hashes of all windows whose smallest gram is repeated."""

    def run(batches):
        for batch in batches:
            hits = batch.column("hits")
            for a, b, texts in _batches(batch):
                words = Words(texts)
                small, text, first = _windows(words, width)
                full = rolling(words.hash, width, 2)
                keep = np.zeros(len(small), bool)
                bounds = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    part = slice(bounds[i], bounds[i + 1])
                    wanted = np.array(hits[a + i].as_py(), np.int64).view(np.uint64)
                    keep[part] = np.isin(small[part], wanted)
                at = words.first[text[keep]] + first[keep]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in KEY),
                     _lists(full[at].view(np.int64), text[keep], b - a, pa.int64()),
                     _lists(first[keep], text[keep], b - a, pa.int32())],
                    [*KEY, "hashes", "starts"])

    return run


def _cut(width: int):
    def run(batches):
        for batch in batches:
            starts = batch.column("starts")
            out = []
            for a, b, texts in _batches(batch):
                for i, text in enumerate(texts, a):
                    at = np.array(starts[i].as_py(), np.int64)
                    words, kept, before, removed = text.split(), [], 0, 0
                    for s, e in zip(*intervals(at, at + width), strict=True):
                        kept += words[before:s]
                        before, removed = e, removed + int(e - s)
                    out.append((removed, b" ".join(kept + words[before:])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEY), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1].decode() for o in out])], [*KEY, "n_removed", "kept_text"])

    return run


def repeated_words(docs: DataFrame, width: int = 13) -> tuple[DataFrame, DataFrame]:
    """Words covered by a window of ``width`` words that starts in a document with a smaller ``doc_id`` too.

    Returns two frames. ``scan``: a row per row of ``docs(doc_id, text)`` with its key, ``n_words``, ``sha``
    (SHA-256 of its words joined by spaces) and ``copy`` (an earlier document has the same text). ``cut``: for texts
    that lose some words and are no copies, ``n_removed`` and ``kept_text``. Only these two columns are read. A null
    text has no words. Rows without ``doc_id`` neither lose words nor make others lose any. Rows that share
    a ``doc_id`` don't count as earlier than each other.

    Every window is hashed by Rabin-Karp. A window can only repeat if its smallest ``GRAM``-word hash
    repeats, so windows are thinned by that first: one gram stands for about four windows. Hashes left are counted
    in Spark with the smallest ``doc_id`` of each, pre-aggregated before the shuffle, and joined back.
    Documents that copy an earlier one are settled by a digest. Keys have 64 bits: two different windows meet by
    chance once in 2**64 pairs.
    """
    docs = keyed(docs)
    scan = stored(docs.mapInArrow(_scan(width), "id long, tag long, digest string, doc_id long, n_words long, sha string, grams array<long>"))
    named = scan.filter("doc_id IS NOT NULL")
    copied = stored(named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
                    .select("digest", "least"))
    flagged = scan.join(narrow(copied), "digest", "left").withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    own = flagged.filter("NOT copy AND doc_id IS NOT NULL").select(*KEY, "grams")
    # Both ends differ only if two documents have it: no distinct count is needed.
    two = lambda df, by: df.groupBy(by).agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    repeated = stored(two(own.select("id", F.explode("grams").alias("gram")), "gram").select("gram"))
    texts = docs.filter("doc_id IS NOT NULL").select(*KEY, "text")
    windows = stored(with_repeated(texts, own, repeated).mapInArrow(
        _candidates(width), "id long, tag long, hashes array<long>, starts array<int>"))
    each = windows.select(*KEY, F.explode(F.arrays_zip("hashes", "starts")).alias("w")).select(
        *KEY, F.col("w.hashes").alias("hash"), F.col("w.starts").alias("start"))
    first = stored(two(each, "hash").select("hash", "least"))
    lost = stored(each.join(first, "hash").filter("id > least").groupBy(KEY).agg(F.collect_set("start").alias("starts")))
    cut = texts.join(narrow(lost.select(KEY)), KEY, "left_semi").join(lost, KEY).mapInArrow(
        _cut(width), "id long, tag long, n_removed long, kept_text string")
    return flagged.select(*KEY, "doc_id", "n_words", "sha", "copy"), cut


def removal_report(docs: DataFrame, width: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row of ``docs``: see ``repeated_words``."""
    scan, cut = repeated_words(docs, width)
    cut = stored(cut.select(*KEY, "n_removed", F.sha2("kept_text", 256).alias("kept")).dropDuplicates(KEY))
    whole = F.col("copy") & (F.col("n_words") >= width)
    return scan.join(narrow(cut), KEY, "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
