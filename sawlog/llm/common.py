"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sawlog.session import checkpoint_dir

#: Rows of a narrow side (keys and a few numbers) that may be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/sawlog/llm/{uuid.uuid4().hex}"


def stored(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """The frame as a table in the shared folder: later steps start from it, whatever executors are lost.

    The shuffle files of the finished step are given back at once. ``arrow_rows``: most rows that Arrow functions of this step are handed
    together, where the session allows more.
    """
    spark = df.sparkSession
    place, wanted = folder(spark), {CLEANUP: "true"}
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), ARROW_ROWS: spark.conf.get(ARROW_ROWS, "10000")}
    if arrow_rows and not 0 < int(before[ARROW_ROWS]) <= arrow_rows:
        wanted[ARROW_ROWS] = str(arrow_rows)
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(place)
    finally:
        for key in wanted:
            spark.conf.set(key, before[key])
    return spark.read.schema(df.schema).parquet(place)


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks a stored, narrow frame for broadcasting if its counted rows are within the bound."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


# --- numpy, inside tasks -------------------------------------------------------------------------

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _MULTIPLIER, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` values: polynomials, taken up by doubling, then finalized."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    factor = powers(width + 1)
    done, size = None, 0
    part, part_size, left = values.astype(np.uint64), 1, width
    while left:
        if left & 1:
            if done is None:
                done, size = part, part_size
            else:
                m = len(values) - size - part_size + 1
                done = done[:m] * factor[part_size] + part[size : size + m]
                size += part_size
        left >>= 1
        if left:
            m = len(values) - 2 * part_size + 1
            part = part[:m] * factor[part_size] + part[part_size : part_size + m]
            part_size *= 2
    return mixed(done + np.uint64((seed * 2 + 1) * 0x632BE59BD9B4E019 % 2**64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


class Words:
    """The words of some texts: hash, text number, and byte span in ``data``."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = (np.searchsorted(self.offsets, self.start, "right") - 1).astype(np.int64)
        if len(self.start):
            length = self.end - self.start
            place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            terms = (raw[inside].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
            sums = np.add.reduceat(terms, np.cumsum(length) - length)
            self.hash = mixed(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, np.uint64)
        # Words per text, and the first word of each.
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow array of strings, read where they are."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return span_hashes(np.frombuffer(data or b"", np.uint8), ends[:-1], ends[1:])


class Seen:
    """Words met so far, numbered in order.

    They are kept as one Arrow array, some tens of bytes a word, with an index of sorted hashes that grows with them; a word found by its hash is compared.
    Most words of a corpus come once, so when there are too many those stay that were met again since the last time.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)  # which were met again

    def _keep(self, kept: np.ndarray) -> np.ndarray:
        """Forgets all but these, in order. The new number of each old one, if it stays."""
        now = np.full(len(self.words), -1, np.int64)
        now[kept] = np.arange(len(kept))
        self.words = self.words.take(pa.array(kept))
        left = now[self.order] >= 0
        self.hashes, self.order = self.hashes[left], now[self.order[left]].astype(np.int32)
        self.again = np.zeros(len(kept), bool)
        return now

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for new ones."""
        at = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            like = np.flatnonzero(self.hashes[place] == hashes)
            known = self.order[place[like]]
            same = np.asarray(pc.equal(self.words.take(pa.array(known)), words.take(pa.array(like)))).astype(bool)
            at[like[same]] = known[same]
        return at

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The number of each of these distinct words, which are new, and which old numbers stay if others were forgotten, else none.

        New words get the next numbers. Before the limit is passed, words not met again are forgotten and the others numbered anew
        from 0, in order; all are forgotten, and all of these words new, where that is not enough.
        """
        hashes = _hashes(words)
        at = self._find(words, hashes)
        self.again[at[at >= 0]] = True
        new, kept = np.flatnonzero(at < 0), None
        if len(self.words) + len(new) > self.limit:
            kept = np.flatnonzero(self.again)
            if len(kept) + len(new) > self.limit:
                kept, new = kept[:0], np.arange(len(words))
            now = self._keep(kept)
            at = np.append(now, -1)[at]  # -1 stays
        at[new] = len(self.words) + np.arange(len(new))
        if len(new):
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new))])
            self.again = np.append(self.again, np.zeros(len(new), bool))
            fresh = new[np.argsort(hashes[new])]
            both = np.concatenate([self.hashes, hashes[fresh]])
            merged = np.argsort(both, kind="stable")  # of two sorted runs
            self.hashes, self.order = both[merged], np.concatenate([self.order, at[fresh].astype(np.int32)])[merged]
        return at, new, kept


def pieces(texts: list[bytes] | list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts (or their sizes) with about ``limit`` bytes together; a long text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        size = text if isinstance(text, int) else len(text)
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_inverses = np.ones(1, np.uint64)


class Prefixes:
    """Rabin-Karp hashes of any spans of a byte string, by differences of prefix sums."""

    def __init__(self, data: bytes):
        global _inverses
        raw = np.frombuffer(data, np.uint8)
        n = len(raw) + 1
        if len(_inverses) < n:
            grown = np.full(max(n, 4096), _INVERSE, np.uint64)
            grown[0] = 1
            _inverses = np.multiply.accumulate(grown)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n)[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * _inverses[start]
        return mixed(value + mixed((end - start).astype(np.uint64) + np.uint64(0x51ED27) * np.asarray(salt).astype(np.uint64)))


def intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal ones; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


KEY = ["id", "tag"]


def key_columns() -> list[Column]:
    number = F.col("doc_id").cast("long")
    # The tag has 64 bits. Rows without a number, of which there can be many, take 64 more from their text in its place.
    return [F.coalesce(number, F.xxhash64(F.lit(1), "text")), F.xxhash64(number.isNull(), "text")]


def keyed(docs: DataFrame) -> DataFrame:
    """``id, tag, digest, doc_id, text``: a key that keeps rows apart that share a ``doc_id`` or have none.

    Rows equal in both columns share their key, and so their results.
    """
    return docs.select(
        *(column.alias(name) for name, column in zip(KEY, key_columns(), strict=True)),
        F.md5(text_or_empty()).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def with_repeated(texts: DataFrame, grams: DataFrame, repeated: DataFrame) -> DataFrame:
    """The texts that hold some of the ``repeated(gram)``, with those they hold as ``hits``.

    ``grams`` has the key and one array ``grams`` per text. Only texts with hits are shuffled where
    their keys are few enough to be broadcast.
    """
    hits = stored(grams.select(*KEY, F.explode("grams").alias("gram")).join(repeated, "gram")
                  .groupBy(KEY).agg(F.collect_set("gram").alias("hits")))
    n = hits.count()
    if n <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(hits.select(KEY)), KEY, "left_semi")
    return texts.join(hits, KEY)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order that do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    before = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(before, length)
    terms = (raw[place + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()) + 1)[place]
    # An empty span has no term of its own.
    sums = np.where(length > 0, np.add.reduceat(np.append(terms, np.uint64(0)), before), np.uint64(0))
    return mixed(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte spans of text as an Arrow array of strings."""
    length = end - start
    ends = np.cumsum(length)
    data = raw[np.arange(int(length.sum())) + np.repeat(start - (ends - length), length)]
    offsets = np.concatenate([[0], ends])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
