"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from sawlog.llm.common import BROADCAST_ROWS, Seen, pieces, stored

TRAIN_ROWS = 20_000  # about as many labelled rows, chosen by a hash, are fitted on
LEXICON = 2_000  # entries at most
EVIDENCE = 22.0  # log-likelihood ratio that an entry needs to be more than chance among all words
STEMS = (4, 5, 6)
NEAR = 5  # words within which an address counts as near
CALIBRATION = 0.3  # share of the training rows that calibrate
CACHE = 1_500_000  # words whose meaning a worker remembers
SLICE = 2 << 20  # bytes of text read at once
SECOND_PERSON = frozenset("""
you your yours yourself u ur tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros vuestro du dich dir dein deine euch euer ihr
""".split())
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_HIDDEN = re.compile(r"[^\W\d_](?:[^\w\s]+|\d+|_+)[^\W\d_]")
_REPEATS = re.compile(r"(.)\1+")
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[33, 63]] = 4
_CLASS[[c for c in range(34, 127) if not chr(c).isalnum() and c != 63]] = 5


def parts(word: str) -> list[str]:
    """A lower-case word, and its stems as marked beginnings."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


def core(token: str) -> str:
    return token.strip(_EDGE).lower()


class Reader:
    """Dense features of texts by a lexicon of weighted words and stems; what a token means is remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.stems = [(n, {p[1:]: w for p, w in lexicon.items() if p[0] == "^" and len(p) == n + 1}) for n in STEMS]
        self.seen, self.kinds = Seen(CACHE), np.zeros((0, 6), np.float32)

    def _weight(self, word: str) -> float:
        get = self.lexicon.get
        return max(get(word, 0.0), *[stems.get(word[:n], 0.0) for n, stems in self.stems])

    def _kind(self, token: str) -> tuple[float, ...] | None:
        """Weight, whether it is in the lexicon plainly or in hiding, second person, shouted, obfuscated; None for plain words."""
        word = token.strip(_EDGE).lower()
        weight, undone, hidden = self._weight(word), 0.0, False
        if not word.isalpha():
            hidden = bool(_HIDDEN.search(word))
            if not weight:
                undone = self._weight("".join(filter(str.isalpha, word.translate(_LEET))))
        if not weight and not undone and _REPEATS.search(word):
            undone = self._weight(_REPEATS.sub(r"\1", "".join(filter(str.isalpha, word.translate(_LEET)))))
        you, shouted = word in SECOND_PERSON, len(word) > 1 and token.isupper()
        if not (weight or undone or you or shouted or hidden):
            return None
        return (weight or undone, float(weight > 0), float(undone > 0), float(you), float(shouted), float(hidden))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A row of features per text."""
        n = len(texts)
        lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, np.asarray(coded.indices)
        at, new, kept = self.seen.numbers(words)
        if kept is not None:
            self.kinds = self.kinds[kept]
        fresh = np.zeros((len(new), 6), np.float32)
        for i, word in enumerate(words.take(pa.array(new)).to_pylist()):
            if (kind := self._kind(word)) is not None:
                fresh[i] = kind
        self.kinds = np.concatenate([self.kinds, fresh])
        kinds = self.kinds[at]
        told = np.flatnonzero((kinds.any(axis=1))[codes])  # tokens that mean something
        text = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
        empty = pc.index(words, "").as_py()
        count = np.bincount(text[codes != empty], minlength=n).astype(float)
        owner, meant = text[told], kinds[codes[told]].astype(float)
        share = np.stack([np.bincount(owner, weights=meant[:, k], minlength=n) for k in range(6)], axis=1)
        hit = meant[:, 0] > 0
        most = np.zeros(n)
        np.maximum.at(most, owner[hit], meant[hit, 0])
        hits = np.bincount(owner[hit], minlength=n).astype(float)
        different = np.unique(np.stack([owner[hit], codes[told][hit]], axis=1), axis=0)[:, 0] if hit.any() else owner[:0]
        near = self._near(told[hit], owner[hit], told[meant[:, 3] > 0], owner[meant[:, 3] > 0], n)
        raw = self._characters(texts)
        size, tokens = np.maximum(raw.sum(axis=1), 1), np.maximum(count, 1)
        return np.stack([
            np.log1p(count), share[:, 1] / tokens, share[:, 2] / tokens, share[:, 0] / tokens, most,
            np.log1p(hits), np.log1p(np.bincount(different, minlength=n)), share[:, 3] / tokens, near / np.maximum(hits, 1),
            raw[:, 1] / np.maximum(raw[:, 1] + raw[:, 2], 1), share[:, 4] / tokens, raw[:, 4] / size, raw[:, 5] / size, raw[:, 3] / size,
            share[:, 5] / tokens, np.log1p(share[:, 2]),
        ], axis=1)

    @staticmethod
    def _near(hits: np.ndarray, hit_text: np.ndarray, you: np.ndarray, you_text: np.ndarray, n: int) -> np.ndarray:
        """Per text, the hits with a second person within ``NEAR`` words."""
        if not len(hits) or not len(you):
            return np.zeros(n)
        place = np.searchsorted(you, hits)
        close = np.zeros(len(hits), bool)
        for side in (np.minimum(place, len(you) - 1), np.maximum(place - 1, 0)):
            close |= (np.abs(you[side] - hits) <= NEAR) & (you_text[side] == hit_text)
        return np.bincount(hit_text[close], minlength=n).astype(float)

    @staticmethod
    def _characters(texts: pa.Array) -> np.ndarray:
        """Bytes of each text by class."""
        return np.array([np.bincount(_CLASS[np.frombuffer(t.encode(), np.uint8)], minlength=6) for t in texts.to_pylist()]).reshape(-1, 6)


FEATURES = 16


def features(lexicon: dict[str, float]):
    """The features as a column function of a text; null is empty. What a task remembers of words ends with it."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(lexicon)
        for texts in batches:
            texts = pc.fill_null(texts, "")
            rows = [reader(texts.slice(a, b - a)) for a, b in pieces(pc.binary_length(texts).to_pylist(), SLICE)]
            values = np.concatenate(rows or [np.zeros((0, FEATURES))]).astype(np.float64).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * FEATURES, pa.int32()), pa.array(values))
        pa.default_memory_pool().release_unused()

    return of


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of ``doc_id`` as text, modulo 3; null where there is none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems that labelled texts ``(text, toxic)`` show to go with toxicity, weighted by log odds.

    Each task counts the texts its words are in; counts are added up in Spark, and only entries with enough
    evidence come back, ``LEXICON`` at most.
    """

    def counted(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in map(core, set((text or "").split())) if w}
                (toxic if label else clean).update({p for w in words for p in parts(w)})
        names = list(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[p] for p in names], pa.int64()),
                                          pa.array([0] * len(names), pa.int64())], ["part", "toxic", "clean"])
        names = list(clean)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()),
                                          pa.array([clean[p] for p in names], pa.int64())], ["part", "toxic", "clean"])

    totals = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    t_all, c_all = float(totals.t or 0), float(totals.c or 0)
    if not t_all or not c_all:
        return {}
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (t + c) / (t_all + c_all)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    evidence = 2 * (term(t, share * t_all) + term(c, share * c_all) + term(t_all - t, (1 - share) * t_all) + term(c_all - c, (1 - share) * c_all))
    weight = F.log((t + 0.5) / (t_all + 1)) - F.log((c + 0.5) / (c_all + 1))
    found = (rows.select("text", F.col("toxic").cast("int")).mapInArrow(counted, "part string, toxic long, clean long")
             .groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic > 2")
             .select("part", evidence.alias("evidence"), weight.alias("weight"))
             .filter((F.col("evidence") >= EVIDENCE) & (F.col("weight") >= 2.0)).orderBy(F.desc("evidence"), "part").limit(LEXICON))
    return {r.part: float(r.weight) for r in found.collect()}


@dataclass
class Toxicity:
    """A fitted model; ``trees`` is missing where the labels have one class only, ``scale`` where they are too few to calibrate."""

    lexicon: dict[str, float]
    trees: Model | None
    scale: Model | None
    base: float

    def scored(self, df: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``df`` with ``name``: 0 to 1. Its own columns are kept aside as one, so they may have any names."""
        columns = [c for c in df.columns if c.lower() != name.lower()]
        held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"))
        if self.trees is None:
            scored = held.select("row", F.lit(self.base).alias("chance"))
        else:
            scored = self.trees.transform(held.withColumn("_tox", array_to_vector(features(self.lexicon)(F.col("text"))))).select(
                "row", vector_to_array("_tox_chance")[1].alias("_tox_one"))
            if self.scale is None:
                scored = scored.withColumnRenamed("_tox_one", "chance")
            else:
                scored = self.scale.transform(scored).select("row", F.least(F.greatest("_tox_scaled", F.lit(0.0)), F.lit(1.0)).alias("chance"))
        return scored.select(*[F.col(f"row.`{c}`") for c in columns], F.col("chance").alias(name))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Toxicity:
    """Learns from ``labels(doc_id, toxic)`` of rows outside the held-out fold.

    At most about ``rows`` labelled documents are used, chosen by a hash of ``doc_id``; a document with several labels is toxic
    if one says so, and labels without a document or a value are left out.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold() != 1).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stored(known)
    n = known.count()
    if n > rows:
        known = known.filter(F.xxhash64("doc_id") < (rows << 64) // n - (1 << 63))  # a share of all 64-bit hashes, however small
    sample = F.broadcast(known) if rows <= BROADCAST_ROWS else known
    train = stored(docs.select("doc_id", "text").join(sample, "doc_id").select(
        "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1000)) < int(1000 * CALIBRATION)).alias("held")))
    lexicon = learned_lexicon(train)
    vectors = stored(train.select(features(lexicon)(F.col("text")).alias("x"), F.col("toxic").cast("double").alias("label"), "held"))
    vectors = vectors.withColumn("_tox", array_to_vector("x"))
    counts = {r.held: (r.t, r.c) for r in vectors.groupBy("held").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()}
    toxic, clean = (sum(v[i] or 0 for v in counts.values()) for i in (0, 1))
    if not toxic or not clean:
        return Toxicity(lexicon, None, None, 1.0 if toxic else 0.0)
    calibrated = min(counts.get(True, (0, 0))) >= 20 and min(counts.get(False, (0, 0))) >= 20
    learner = GBTClassifier(featuresCol="_tox", labelCol="label", predictionCol="_tox_class", maxIter=30, maxDepth=3, stepSize=0.2, seed=7)
    trees = learner.setRawPredictionCol("_tox_raw").setProbabilityCol("_tox_chance").fit(vectors.filter("NOT held") if calibrated else vectors)
    scale = None
    if calibrated:
        judged = trees.transform(vectors.filter("held")).select("label", vector_to_array("_tox_chance")[1].alias("_tox_one"))
        scale = IsotonicRegression(featuresCol="_tox_one", labelCol="label", predictionCol="_tox_scaled").fit(judged)
    return Toxicity(lexicon, trees, scale, toxic / (toxic + clean))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``; a null text is empty, a null ``doc_id`` not held out."""
    model = fit(docs, labels)
    return model.scored(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), F.col("score").cast("double").alias("score"),
        (F.col("score") >= threshold).cast("int").alias("predicted"))
