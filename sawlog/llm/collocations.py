"""Phrase collocations: mergeable Misra-Gries summaries find what may be frequent, a second pass counts it exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sawlog.llm.common import mixed, pieces, span_hashes, stored, strings

LONGEST = 4  # words of a phrase
STRETCH = 1 << 20  # bytes of text read at once
PART = 1_000_000  # occurrences in a hash partition, about; its summary is made in one task
MARKS = 1 << 26  # bits of the table that thins the second pass, whatever survives the first
TOP_ROWS = 50_000  # rows ranked in one task
UNKNOWN = "und"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE, _END = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _SPACE
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _END
_STEP = np.uint64(0xA24BAED4963EE407)


@dataclass
class Stretch:
    """The words of a stretch of joined texts: byte span, hash with language, piece, and owner among the texts.

    The first ``carried`` words were in the stretch before; what ends in them has been counted there.
    """

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    text: np.ndarray
    carried: int

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``k``, first words and hashes of all phrases of ``k`` words within pieces, for ``k`` from 1."""
        value = mixed(self.hash)
        for k in range(1, min(longest, len(self.hash)) + 1):
            if k > 1:
                value = mixed(value[:-1] * _STEP + self.hash[k - 1 :])
            first = np.arange(max(0, self.carried - k + 1), len(value))
            first = first[self.piece[first] == self.piece[first + k - 1]]
            yield k, first, value[first]

    def phrases(self, k: int, first: np.ndarray) -> pa.Array:
        """The words from each of ``first`` on, joined by one space."""
        words = [strings(self.raw, self.start[first + i], self.end[first + i]) for i in range(k)]
        return words[0] if k == 1 else pc.binary_join_element_wise(*words, " ")


def stretches(texts: list[bytes], salts: np.ndarray, limit: int, longest: int) -> Iterator[Stretch]:
    """All words of the lower-cased texts, about ``limit`` bytes at a time; cuts lie between words.

    ``salts`` has a number per text that tells languages apart in hashes. Texts end pieces. A text of any length is read, stretch by stretch;
    the last words of a stretch are carried into the next one.
    """
    data = b"\n".join(texts).translate(_LOWER) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    begin = fresh = 0
    while fresh < len(raw):
        end = min(fresh + limit, len(raw))
        while end < len(raw) and not _KIND[raw[end - 1]]:
            gaps = np.flatnonzero(_KIND[raw[end : end + 4096]])
            end = end + int(gaps[0]) + 1 if len(gaps) else min(end + 4096, len(raw))
        part = raw[begin:end]
        kind = _KIND[part]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        text = np.searchsorted(offsets, start + begin, "right") - 1
        piece = np.cumsum(kind == _END)[start]
        value = span_hashes(part, start, stop) + salts[text]
        yield Stretch(part, start, stop, value, piece, text, int(np.searchsorted(start, fresh - begin)))
        fresh = end
        begin = begin + int(start[-longest + 1]) if len(start) >= longest > 1 else (begin if longest > 1 else end)


def gathered(batch: pa.RecordBatch, limit: int, longest: int) -> Iterator[tuple[pa.Array, Stretch]]:
    """Stretches of a batch of ``lang, text``, and the languages of their texts."""
    texts = batch.column(1)
    for a, b in pieces(pc.binary_length(texts).to_pylist(), limit):
        some, langs = texts.slice(a, b - a).cast(pa.binary()).to_pylist(), batch.column(0).slice(a, b - a)
        coded = langs.dictionary_encode()
        names = [name.encode() for name in coded.dictionary.to_pylist()]
        joined = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(name) for name in names])
        # Hashed once more: else a word and a language would make one sum with their names exchanged.
        salts = mixed(span_hashes(joined, ends - [len(name) for name in names], ends) + _STEP)
        for stretch in stretches(some, salts[np.asarray(coded.indices)], limit, longest):
            yield langs, stretch


def identified(value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition of a phrase, by the upper bits of its hash, and its 32-bit key there."""
    part = (value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return part, value & np.uint64(0xFFFFFFFF)


def marks(part: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    return mixed(part << np.uint64(32) | key) % np.uint64(bits)


class Summary:
    """A Misra-Gries summary of weighted keys.

    With more than ``mass / threshold`` counters, of a stream of ``mass``, no key of ``threshold`` and more is lost: whenever counters are
    too many, all are lowered by the first surplus one in order of size, which takes that amount from more than ``capacity`` counters. ``lowered`` is how much any key can be missing.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lowered = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds another summary's counters, or plain counts."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)) != 0) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[new], np.add.reduceat(counts, new) if len(new) else counts
        if len(self.counts) > self.capacity:
            surplus = len(self.counts) - self.capacity - 1
            by = int(np.partition(self.counts, surplus)[surplus])
            left = self.counts > by
            self.keys, self.counts = self.keys[left], self.counts[left] - by
            self.lowered += by

    def at_least(self, threshold: int) -> np.ndarray:
        """Keys whose count may reach the threshold: all that do, and some that do not."""
        return self.keys[self.counts + self.lowered >= threshold]


def survivors(docs: DataFrame, threshold: int, longest: int, parts: int, limit: int = STRETCH) -> DataFrame:
    """``part, key`` of every phrase in ``docs(lang, text)`` that may occur ``threshold`` times.

    Each stretch sends its counts to the owners of the hash partitions, where they are merged into one summary whose capacity exceeds the
    partition's mass over the threshold.
    """

    def counted(batches):
        for batch in batches:
            for _, stretch in gathered(batch, limit, longest):
                keys, counts = np.unique(np.concatenate([value for _, _, value in stretch.grams(longest)] or [np.zeros(0, np.uint64)]), return_counts=True)
                part, key = identified(keys, parts)
                first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
                spans = list(zip(first.tolist(), np.append(first, len(part))[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first].astype(np.int64)), pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64()),
                     pa.array([key[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                     pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())], ["part", "mass", "keys", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        summary = Summary(pc.sum(table.column("mass")).as_py() // threshold + 1)
        held, size = [], 0
        for row, (keys, counts) in enumerate(zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True), 1):
            held.append((np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)))
            size += len(keys) // 4
            if size > max(summary.capacity, 1 << 16) or row == table.num_rows:
                summary.merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                held, size = [], 0
        found = summary.at_least(threshold)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(found), pa.int64()), "key": pa.array(found.astype(np.int64))})

    return docs.mapInArrow(counted, "part long, mass long, keys binary, counts binary").groupBy("part").applyInArrow(summed, "part long, key long")


def marked(found: DataFrame, bits: int) -> np.ndarray:
    """A table of ``bits`` bits with those of ``found(part, key)`` set, made in Spark; only its words, of fixed number, come back."""

    def placed(batches):
        for batch in batches:
            at = marks(*(np.asarray(c).astype(np.uint64) for c in batch.columns), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))], ["word", "bit"])

    words = found.mapInArrow(placed, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return out


def exact_counts(docs: DataFrame, threshold: int, longest: int, parts: int, table: np.ndarray, limit: int = STRETCH) -> DataFrame:
    """``lang, k, phrase, f`` of phrases that occur ``threshold`` times and more, counted by the phrases themselves; ``k`` 0 has all words.

    Only phrases in ``table`` are written out, so few others are shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)

    def counted(batches):
        for batch in batches:
            for langs, stretch in gathered(batch, limit, longest):
                words = np.bincount(stretch.text[stretch.carried :], minlength=len(langs))
                yield _rows(langs, np.flatnonzero(words), 0, pa.array([""] * int((words > 0).sum()), pa.string()), words[words > 0])
                for k, first, value in stretch.grams(longest):
                    at = marks(*identified(value, parts), 64 * len(held.value))
                    told = (held.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                    _, one, n = np.unique(value[told], return_index=True, return_counts=True)
                    one = first[told][one]
                    yield _rows(langs, stretch.text[one], k, stretch.phrases(k, one), n)

    return docs.mapInArrow(counted, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(
        F.sum("f").alias("f")).filter((F.col("f") >= threshold) | (F.col("k") == 0))


def _rows(langs: pa.Array, text: np.ndarray, k: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(text, pa.int64())), pa.array(np.full(len(text), k, np.int32)), phrases, pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "f"])


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def _joined(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of all phrases of two words and more: the lowest of their cuts, at the smallest place among equals."""
    words = F.split("phrase", " ")
    phrases = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "*", _joined(words, F.lit(1), F.col("cut")).alias("left"), _joined(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    known = counts.filter("k >= 1")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # A quotient of decimals as whole numbers: products beyond 64 bits stay exact.
    score = F.expr("(2000000 * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    return cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")).select(
        "lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that are not part of a longer one that occurs in ``percent`` of their places and more."""
    words, k = F.split("phrase", " "), F.col("k")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(
        F.sequence(F.lit(1), k - n + 1), lambda at: _joined(words, at, n))))
    longer = phrases.filter("k >= 3").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * _exact("longer") < percent * _exact("a"))).drop("longer")


def first_of_each(rows: DataFrame, key: str, order: list[Column], top: int, spread: str) -> DataFrame:
    """The first ``top`` rows of each key, with ``rank``, for a stored frame.

    Ranked in levels: keys are split by ``spread`` so that a task ranks about ``TOP_ROWS`` rows, and what is among the first there goes on.
    """
    salts = -(-rows.count() // TOP_ROWS)
    while salts > 1:
        place = Window.partitionBy(key, F.pmod(F.xxhash64(spread), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).drop("rank")
        salts = -(-salts // max(2, TOP_ROWS // top))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, percent: int = 80, longest: int = LONGEST, part: int = PART,
                 limit: int = STRETCH) -> DataFrame:
    """The strongest phrases of two to ``longest`` words of ``docs(lang, text)``, per language.

    Returns ``lang, rank, phrase, a, l, r, n, score``. A null language is ``und``; a null or empty text has no words; every row counts, repeated ones too;
    other columns are not read; ties go by phrase; an empty table gives no row. A text of any length is read, in stretches; a single word beyond a stretch makes it longer.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size * longest // (6 * part))  # some six bytes a word
    found = stored(survivors(texts, threshold, longest, parts, limit))
    counts = stored(exact_counts(texts, threshold, longest, parts, marked(found, MARKS), limit))
    kept = stored(uncovered(scored(counts), percent))
    ranked = first_of_each(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    words = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
