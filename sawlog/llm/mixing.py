"""Language-model scores: hashed-context bit predictors, mixed by online logistic regression and refined."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sawlog.llm.common import Words, mixed, pieces, stored

LEADING = 18  # bits of a word's hash that it is looked up by
CODED = 1 << 18  # words with a code of their own; all others are spelled
AREAS = (1 << 20, 1 << 22, 1 << 23)  # slots of each context's predictor
SLOTS = sum(AREAS)
STEP = 4  # bits whose nodes lie side by side
SIDE, OUTCOMES = 1 << STEP, 2 << STEP  # slots of a place, and outcomes of a step, with two unused
RANGES = 256  # parts of all places, each added up in one group
SLICE = 1 << 19  # bytes of texts scored side by side
LONG = 1 << 18  # bytes beyond which a text is read in stretches
COUNTED = 4 << 20  # bytes whose words are counted at once
CHUNK = 1 << 18  # symbols of a long text that are followed at once
PART = 1 << 13  # symbols that are taken apart at once, so that what is made of them stays in a core's cache
BLOCK = 512  # bits after which weights and refinement follow a text
RATE = 0.002  # of a text's own share of the weights
TUNING_RATE = 0.0001  # of the weights that all texts start from
INERTIA = 60.0  # bits that the refinement starts from, in weight
ROUNDS = 1  # passes over the tuning fold
FOLDS, TUNING = 10, 9
LIMIT = 8.0  # of log odds
CONTEXTS, GATES, BUCKETS = 3, 16, 24
FIRST = (0.25, 0.4, 0.5)  # weights before any tuning
#: Weights of bytes in spelling; 32 ends a word.
LETTERS = [64 if b == 32 else 32 if 97 <= b <= 122 else 8 if 48 <= b <= 57 else 4 if 128 <= b < 192 else 1 for b in range(256)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END_HASH = np.uint64(0x9D39247E33776D41)
_STEP, _SPELLED, _NODE, _SPREAD = np.uint64(0xA24BAED4963EE407), np.uint32(0x6659FD93), np.uint32(0x1E98DF25), np.uint32(0x9E3779B1)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of ``doc_id`` as text, modulo 10; null where there is none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


# --- the code ------------------------------------------------------------------------------------


def prefix_code(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Huffman's code for symbols of these counts: bits as a number, and how many."""
    least = max(1, sum(counts) >> 38)  # no code is longer than some 56 bits
    heap = [(max(least, n), i, None) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], tie, (a, b)))
        tie += 1
    length = np.zeros(len(counts), np.int64)
    todo = [(heap[0], 0)]
    while todo:
        (_, i, inner), depth = todo.pop()
        if inner is None:
            length[i] = max(depth, 1)
        else:
            todo += [(inner[0], depth + 1), (inner[1], depth + 1)]
    value, code, before = np.zeros(len(counts), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(counts)), length)).tolist():
        size = int(length[i])
        code <<= size - before
        value[i], before = code, size
        code += 1
    return value, length


SPELLING = prefix_code(LETTERS)


@dataclass
class Code:
    """Coded words as sorted hashes with their counts, and codes for these, for the end and for the escape to spelling."""

    words: np.ndarray
    counts: np.ndarray
    value: np.ndarray
    length: np.ndarray

    def __post_init__(self):
        self._first = np.searchsorted(self.words >> np.uint64(64 - LEADING), np.arange((1 << LEADING) + 1, dtype=np.uint64))

    @property
    def end(self) -> int:
        return len(self.words)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word; that of the escape for words without a code."""
        out = np.full(len(hashes), self.end + 1)
        if not len(self.words):
            return out
        bucket = hashes >> np.uint64(64 - LEADING)
        at, stop, left = np.take(self._first, bucket), np.take(self._first, bucket + np.uint64(1)), None
        while True:
            # Words are sorted, so those with the same leading bits stand together.
            same = np.take(self.words, np.minimum(at, self.end - 1)) == hashes
            same &= at < stop
            if left is None:
                out[same] = at[same]
            else:
                out[left[same]] = at[same]
            more = np.flatnonzero(~same & (at + 1 < stop))
            if not len(more):
                return out
            left = more if left is None else left[more]
            at, stop, hashes = at[more] + 1, stop[more], hashes[more]


def code_of(words: np.ndarray, counts: np.ndarray, texts: int, others: int) -> Code:
    order = np.argsort(words)
    value, length = prefix_code([*counts[order].tolist(), max(texts, 1), max(others, 1)])
    return Code(words[order], counts[order], value, length)


# --- texts as symbols, symbols as bits --------------------------------------------------------------


def stretches(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut between words, every ``limit`` bytes or at the next white space."""
    at = 0
    while at < len(text):
        end = min(at + limit, len(text))
        while end < len(text) and text[end - 1] not in b"\t\n\v\f\r ":
            end += 1
        yield text[at:end]
        at = end


@dataclass
class Symbols:
    """Symbols of some texts in order: bits, number of bits, hashed contexts ``[context, symbol]``, text, and kind: a code's number, or after these a byte."""

    value: np.ndarray
    length: np.ndarray
    contexts: np.ndarray
    text: np.ndarray
    kind: np.ndarray

    def chunks(self, size: int) -> Iterator[Symbols]:
        for a in range(0, len(self.value), size):
            part = slice(a, a + size)
            yield Symbols(self.value[part], self.length[part], self.contexts[:, part], self.text[part], self.kind[part])


def kinds(code: Code) -> Symbols:
    """One symbol of each kind, with the context that is none."""
    n, letters = len(code.value), len(LETTERS)
    context = np.zeros((CONTEXTS, n + letters), np.uint32)
    context[0, n:] = _SPELLED
    size = np.arange(n + letters)
    return Symbols(np.concatenate([code.value, SPELLING[0]]), np.concatenate([code.length, SPELLING[1]]), context, np.zeros_like(size), size)


def symbols(words: Words, code: Code, before: np.ndarray, ended: bool) -> tuple[Symbols, np.ndarray]:
    """Every token as its code, or as the escape and its bytes, which a blank ends.

    Contexts of a code are none, the token before and the two before; those of a byte are none, the byte before it in its word and the three
    before. ``before[text]`` are the two tokens before the first, latest first. Returns also the number of each word's code.
    """
    n, w = len(words.count), len(words.hash)
    ends = 1 if ended else 0
    token = np.full(w + ends * n, _END_HASH, np.uint64)
    place = np.arange(w) + (words.text if ended else 0)
    token[place] = words.hash
    text = np.repeat(np.arange(n), words.count + ends)
    number = np.full(len(token), code.end)
    found = code.find(words.hash)
    number[place] = found
    first = np.cumsum(words.count + ends) - (words.count + ends)
    rank = np.arange(len(token)) - first[text]
    last = np.where(rank >= 1, np.roll(token, 1), before[text, 0])
    second = np.where(rank >= 2, np.roll(token, 2), np.where(rank == 1, before[text, 0], before[text, 1]))
    context = np.stack([np.zeros(len(token), np.uint64), mixed(last + np.uint64(1)), mixed(last * _STEP + second + np.uint64(2))]) >> np.uint64(32)
    size = np.ones(len(token), np.int64)
    spelled = np.flatnonzero(found > code.end)
    letters = (words.end - words.start)[spelled] + 1
    size[place[spelled]] += letters
    at = np.cumsum(size) - size
    value, length = np.zeros(int(size.sum()), np.uint64), np.zeros(int(size.sum()), np.int64)
    contexts = np.zeros((CONTEXTS, len(value)), np.uint32)
    value[at], length[at], contexts[:, at] = code.value[number], code.length[number], context
    kind = np.zeros(len(value), np.int32)
    kind[at] = number
    if len(spelled):
        raw = np.frombuffer(words.data, np.uint8)
        within = np.arange(int(letters.sum())) - np.repeat(np.cumsum(letters) - letters, letters)
        source = np.repeat(words.start[spelled], letters) + within
        byte = np.where(within == np.repeat(letters - 1, letters), 32, raw[np.minimum(source, len(raw) - 1)])
        where = np.repeat(at[place[spelled]] + 1, letters) + within
        value[where], length[where], kind[where] = SPELLING[0][byte], SPELLING[1][byte], len(code.value) + byte.astype(np.int32)
        byte, history = byte.astype(np.uint64), np.zeros(len(byte), np.uint64)
        for back in range(1, 4):
            history = np.where(within >= back, history | np.roll(byte, back) << np.uint64(8 * (back - 1)), history)
            if back in (1, 3):
                contexts[{1: 1, 3: 2}[back], where] = mixed(history + np.uint64(back * 0xD6E8FEB86659FD93 % 2**64)) >> np.uint64(32)
        contexts[0, where] = _SPELLED
    return Symbols(value, length, contexts, np.repeat(text, size), kind), found


def _outcomes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each outcome of a step, and each of its bits: whether it has that many, the node that the bit is told in, and the bit itself."""
    used, node, bit = np.zeros((OUTCOMES, STEP), bool), np.zeros((OUTCOMES, STEP), np.int64), np.zeros((OUTCOMES, STEP), bool)
    for n in range(1, STEP + 1):
        for own in range(1 << n):
            outcome = (1 << n) - 2 + own
            used[outcome, :n] = True
            for depth in range(n):
                node[outcome, depth] = (1 << depth) + (own >> n - depth)
                bit[outcome, depth] = own >> n - depth - 1 & 1
    return used, node, bit


_USED, _NODES, _BITS = _outcomes()


def steps(of: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols taken apart into steps of up to four bits: places ``[context, step]``, outcomes, and how many steps each symbol has.

    The nodes of a step's bits lie side by side in one place of each context, which one hash of the context and of the bits before the step finds.
    An outcome tells how many bits the step has, and which.
    """
    count = (of.length + STEP - 1) // STEP
    before = (np.arange(int(count.sum()), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)) * np.int32(STEP)
    left = np.repeat(of.length.astype(np.int32), count) - before
    size = np.minimum(left, np.int32(STEP))
    value = np.repeat(of.value, count)
    prefix = (value >> left.astype(np.uint64)) + np.left_shift(np.uint64(1), before.astype(np.uint64))
    prefix = (prefix ^ prefix >> np.uint64(32)).astype(np.uint32) * _NODE
    ends = np.left_shift(np.int32(1), size)
    outcome = ((value >> (left - size).astype(np.uint64)).astype(np.int32) & (ends - np.int32(1))) + ends - np.int32(2)
    places, area = np.empty((CONTEXTS, len(outcome)), np.int32), 0
    for k, slot_count in enumerate(AREAS):
        place = (np.repeat(of.contexts[k], count) + prefix) * _SPREAD >> np.uint32(37 - slot_count.bit_length())
        np.add(place, np.uint32(area), out=places[k], casting="unsafe")
        area += slot_count // SIDE
    return places, outcome, count


def said(table: np.ndarray, of: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the symbols, and what the table of predictions says of each: ``[context, bit]``. A bit is told in the node that the bits before it lead to."""
    n = int(of.length.sum())
    bit, out, end = np.empty(n, bool), np.empty((CONTEXTS, n), table.dtype), 0
    rows = table.reshape(-1, SIDE)
    for part in of.chunks(PART):
        places, outcome, _ = steps(part)
        own = np.flatnonzero(np.take(_USED, outcome, axis=0))
        node = np.take(_NODES, outcome, axis=0)
        node += np.arange(0, SIDE * len(outcome), SIDE)[:, None]
        node = np.take(node, own)
        begin, end = end, end + len(own)
        bit[begin:end] = np.take(np.take(_BITS, outcome, axis=0), own)
        for k in range(CONTEXTS):
            # All of a step's bits are read from one row.
            out[k, begin:end] = np.take(np.take(rows, places[k], axis=0), node)
    return bit, out


def by_node(counts: np.ndarray) -> np.ndarray:
    """Counts ``[place, outcome]`` as zeros and ones ``[slot, bit]``: what ends in a step's last bit, or goes on below it, was told in each node above."""
    out = np.zeros((len(counts), SIDE, 2), counts.dtype)
    below: np.ndarray | int = 0
    for depth in reversed(range(STEP)):
        told = (counts[:, (2 << depth) - 2 : (4 << depth) - 2] + below).reshape(len(counts), 1 << depth, 2)
        out[:, 1 << depth : 2 << depth] = told
        below = told.sum(axis=2)
    return out.reshape(-1, 2)


# --- the model -----------------------------------------------------------------------------------


def predictions(counts: np.ndarray) -> np.ndarray:
    """Counts ``[slot, bit]`` as what a predictor says: log odds in 14 bits, and two bits for how often it was asked."""
    zero, one = counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64)
    odds = np.clip(np.log((one + 0.4) / (zero + 0.4)), -LIMIT + 0.01, LIMIT - 0.01)
    asked = np.searchsorted([1, 4, 32], zero + one, "right")
    return (np.rint(odds * 1024).astype(np.int16) << 2) | asked.astype(np.int16)


@dataclass
class Model:
    """Code, table of predictions, and what every text starts from: weights by gate and the refinement by bucket."""

    code: Code
    table: np.ndarray
    weights: np.ndarray
    refined: np.ndarray


def start(code: Code, table: np.ndarray) -> Model:
    weights = np.tile(np.array(FIRST, np.float32), (GATES, 1))
    refined = 1 / (1 + np.exp(-((np.arange(BUCKETS) + 0.5) * (2 * LIMIT / BUCKETS) - LIMIT)))
    return Model(code, table, weights, refined.astype(np.float32))


@dataclass
class State:
    """What follows each text: its own share of the weights, its refinement, and its log probability."""

    own: np.ndarray
    refined: np.ndarray
    score: np.ndarray

    @classmethod
    def of(cls, model: Model, texts: int) -> State:
        return cls(np.zeros((texts, CONTEXTS), np.float32), np.repeat(model.refined[None], texts, 0), np.zeros(texts))

    def take(self, texts: np.ndarray) -> State:
        return State(self.own[texts], self.refined[texts], self.score[texts])

    def put(self, texts: np.ndarray, other: State) -> None:
        self.own[texts], self.refined[texts], self.score[texts] = other.own, other.refined, other.score


def follow(model: Model, bit: np.ndarray, said: np.ndarray, sizes: np.ndarray, state: State, gates: np.ndarray | None = None) -> State:
    """Codes the bits of texts side by side, block by block; ``said[context, bit]`` is what the predictors say.

    A bit's probability is made from the weights of its gate, which is how well its two strongest contexts are known, and the text's own share; it is then averaged with what
    bits with such a probability have turned out to be in the text. Share and refinement follow the text after each block only, so what is told never uses what comes later.
    With ``gates``, which counts bits by gate, the model's weights follow all texts, too.
    """
    order = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    now = state.take(order)
    span = np.arange(BLOCK)
    edge = np.float32(LIMIT - 0.01)
    for at in range(0, int(size.max(initial=0)), BLOCK):
        n = int(np.searchsorted(-size, -at, "left"))
        length = np.minimum(size[:n] - at, BLOCK)
        first = np.cumsum(length) - length
        # All bits of the block, text after text.
        text = np.repeat(np.arange(n, dtype=np.int32), length)
        where = (begin[:n, None] + at + span)[span[None] < length[:, None]] if length[-1] < BLOCK else (begin[:n, None] + at + span).reshape(-1)
        told = np.take(said, where, axis=1)
        x = (told >> 2).astype(np.float32)
        x *= np.float32(1 / 1024)
        gate = (told[1] & 3) * np.int16(4) + (told[2] & 3)
        dot = np.zeros(len(where), np.float32)
        for k in range(CONTEXTS):
            dot += (np.take(model.weights[:, k], gate) + np.repeat(now.own[:n, k], length)) * x[k]
        np.clip(dot, -edge, edge, out=dot)
        chance = 1 / (1 + np.exp(-dot))
        bucket = ((dot + np.float32(LIMIT)) * np.float32(BUCKETS / (2 * LIMIT))).astype(np.int32) + BUCKETS * text
        one = np.take(bit, where)
        final = (chance + np.take(now.refined[:n].reshape(-1), bucket)) * np.float32(0.5)
        now.score[:n] += np.add.reduceat(np.log(np.abs(final - ~one)), first, dtype=np.float64)
        error = one - chance
        for k in range(CONTEXTS):
            slope = error * x[k]
            now.own[:n, k] += RATE * np.add.reduceat(slope, first)
            if gates is not None:
                model.weights[:, k] += TUNING_RATE * np.bincount(gate, weights=slope, minlength=GATES)
        seen = np.bincount(bucket * 2 + one, minlength=2 * n * BUCKETS).reshape(n, BUCKETS, 2)
        now.refined[:n] = (now.refined[:n] * INERTIA + seen[:, :, 1]) / (INERTIA + seen.sum(axis=2))
        if gates is not None:
            gates += np.bincount(gate, minlength=GATES)
    state.put(order, now)
    return state


@dataclass
class Told:
    """Of some texts: state after them, tokens, coded words with their counts' logarithms, and words without a code."""

    state: State
    tokens: np.ndarray
    coded: np.ndarray
    base: np.ndarray
    rare: list[np.ndarray]


def tell(model: Model, texts: list[bytes], gates: np.ndarray | None = None) -> Told:
    """Codes lower-cased texts; those beyond ``LONG`` bytes alone, stretch by stretch. ``gates`` as in ``follow``."""
    n = len(texts)
    out = Told(State.of(model, n), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), [np.zeros(0, np.uint64)] * n)
    logs = np.log10(model.code.counts + 0.1)
    short = [i for i, text in enumerate(texts) if len(text) <= LONG]

    def run(numbers: list[int], some: list[bytes], before: np.ndarray, ended: bool) -> Words:
        words = Words(some)
        of, found = symbols(words, model.code, before, ended)
        own = np.array(numbers)
        state = out.state.take(own)
        # Several texts are one slice; a stretch of one text may have many symbols.
        for part in of.chunks(CHUNK) if len(some) == 1 else [of]:
            bit, told = said(model.table, part)
            follow(model, bit, told, np.bincount(part.text, weights=part.length, minlength=len(some)).astype(np.int64), state, gates)
        out.state.put(own, state)
        known = found < model.code.end
        out.tokens[own] += words.count
        out.coded[own] += np.bincount(words.text[known], minlength=len(some))
        out.base[own] += np.bincount(words.text[known], weights=logs[found[known]], minlength=len(some))
        upto = np.cumsum(np.bincount(words.text[~known], minlength=len(some)))
        for i, rare in zip(numbers, np.split(words.hash[~known], upto[:-1]), strict=True):
            out.rare[i] = np.concatenate([out.rare[i], rare])
        return words

    if short:
        run(short, [texts[i] for i in short], np.zeros((len(short), 2), np.uint64), True)
    for i in range(n):
        if len(texts[i]) > LONG:
            before, rest = np.zeros((1, 2), np.uint64), list(stretches(texts[i], LONG))
            for k, stretch in enumerate(rest):
                last = run([i], [stretch], before, k == len(rest) - 1).hash[-2:][::-1]
                before = np.concatenate([last[None], before], axis=1)[:, :2]
    return out


def _sliced(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Lower-cased texts of a batch, those of like length together."""
    size = np.asarray(pc.binary_length(texts))
    order = np.argsort(size, kind="stable")
    for a, b in pieces(size[order].tolist(), limit):
        some = texts.take(pa.array(order[a:b])).cast(pa.binary()).to_pylist()
        yield order[a:b], [text.translate(_LOWER) for text in some]


# --- Spark ---------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c``: how often each word, by its hash, occurs in ``docs(text)``."""

    def counted(batches):
        for batch in batches:
            for _, texts in _sliced(batch.column(0), COUNTED):
                for some in [texts] if len(texts) > 1 else ([part] for part in stretches(texts[0], COUNTED)):
                    word, c = np.unique(Words(some).hash, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])

    return docs.select("text").mapInArrow(counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _code(counts: DataFrame, texts: int, total: int) -> Code:
    top = counts.orderBy(F.desc("c"), "word").limit(CODED).toArrow()
    words, c = np.asarray(top.column("word")).view(np.uint64), np.asarray(top.column("c"))
    return code_of(words, c, texts, total - int(c.sum()))


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _spread(data: bytes, kind: np.dtype | type, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def context_counts(docs: DataFrame, code: Code) -> DataFrame:
    """``part, tuning, counts``: how often ``docs(text, tuning)`` has each outcome in each place, by range of places, apart for the tuning fold.

    A task counts into two arrays and sends them range by range, in compressed bytes with the counts beyond a byte apart; each range is added up by
    one owner.
    """
    held = docs.sparkSession.sparkContext.broadcast(code)
    width = 2 * SLOTS // RANGES

    def counted(batches):
        tables: dict[bool, np.ndarray] = {}
        every = kinds(held.value)
        met: dict[bool, np.ndarray] = {}
        one = np.uint32(1)

        def add(tuning: bool, words: Words, before: np.ndarray, ended: bool) -> None:
            of, _ = symbols(words, held.value, before, ended)
            # Without a context, symbols of a kind are alike: their steps are counted at the end.
            met[tuning] += np.bincount(of.kind, minlength=len(every.kind))
            for part in of.chunks(PART):
                places, outcome, _ = steps(part)
                for place in places[1:]:
                    np.add.at(tables[tuning], place.astype(np.int64) * OUTCOMES + outcome, one)

        for batch in batches:
            for tuning in (False, True):
                own = batch.column(0).filter(pc.equal(batch.column(1), tuning))
                if len(own) and tuning not in tables:
                    tables[tuning], met[tuning] = np.zeros(2 * SLOTS, np.uint32), np.zeros(len(every.kind), np.int64)
                for _, texts in _sliced(own, SLICE):
                    if len(texts) > 1 or len(texts[0]) <= LONG:
                        add(tuning, Words(texts), np.zeros((len(texts), 2), np.uint64), True)
                        continue
                    before, rest = np.zeros((1, 2), np.uint64), list(stretches(texts[0], LONG))
                    for k, stretch in enumerate(rest):
                        words = Words([stretch])
                        add(tuning, words, before, k == len(rest) - 1)
                        before = np.concatenate([words.hash[-2:][::-1][None], before], axis=1)[:, :2]
        for tuning, table in tables.items():
            places, outcome, size = steps(every)
            np.add.at(table, places[0].astype(np.int64) * OUTCOMES + outcome, np.repeat(met[tuning], size).astype(np.uint32))
            for part in range(RANGES):
                own = table[part * width : (part + 1) * width]
                over = np.flatnonzero(own >= 255)
                if own.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([tuning]), pa.array([_squeezed(np.minimum(own, 255).astype(np.uint8))], pa.binary()),
                         pa.array([over.astype("<u4").tobytes()], pa.binary()), pa.array([own[over].astype("<u4").tobytes()], pa.binary())],
                        ["part", "tuning", "low", "over", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for low, over, counts in zip(*(table.column(c).to_pylist() for c in ("low", "over", "counts")), strict=True):
            total += _spread(low, np.uint8, width)
            total[np.frombuffer(over, "<u4")] += np.frombuffer(counts, "<u4").astype(np.int64) - 255
        return pa.table({"part": table.column("part").slice(0, 1), "tuning": table.column("tuning").slice(0, 1),
                         "counts": pa.array([_squeezed(total.astype("<i8"))], pa.binary())})

    return docs.select("text", "tuning").mapInArrow(counted, "part int, tuning boolean, low binary, over binary, counts binary").groupBy("part", "tuning").applyInArrow(
        summed, "part int, tuning boolean, counts binary")


def _predictions(counts: DataFrame) -> np.ndarray:
    """The table of predictions, of fixed size."""
    width = SLOTS // RANGES

    def told(table: pa.Table) -> pa.Table:
        total = sum(_spread(c, np.dtype("<i8"), 2 * width) for c in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "said": pa.array([predictions(by_node(total.reshape(-1, OUTCOMES))).astype("<i2").tobytes()], pa.binary())})

    out = np.tile(predictions(np.zeros((1, 2), np.int64)), SLOTS)
    for r in counts.groupBy("part").applyInArrow(told, "part int, said binary").toLocalIterator():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.said, "<i2")
    return out


def tuned(docs: DataFrame, model: Model) -> Model:
    """The model with weights and refinements that have followed ``docs(text)``.

    Every task mixes its texts online, starting from the same weights; what tasks end with is averaged by the bits it comes from.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = replace(held.value, weights=held.value.weights.astype(np.float64))
        gates, refined, total = np.zeros(GATES, np.int64), np.zeros(BUCKETS), 0.0
        for batch in batches:
            for _, some in _sliced(batch.column(0), SLICE):
                told = tell(own, some, gates)
                refined += (told.state.refined * told.tokens[:, None]).sum(axis=0)
                total += told.tokens.sum()
        values = np.concatenate([(own.weights * gates[:, None]).reshape(-1), gates, refined, [total]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    sums = docs.select("text").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    held.destroy()
    values = np.array([r.value for r in sums])
    if not len(values) or not values[-1]:
        return model
    split = GATES * CONTEXTS
    weights, gates, refined = values[:split].reshape(GATES, CONTEXTS), values[split : split + GATES], values[split + GATES : -1]
    weights = np.where(gates[:, None] > 0, weights / np.maximum(gates, 1)[:, None], model.weights)
    return replace(model, weights=np.round(weights, 6).astype(np.float32), refined=np.round(refined / values[-1], 6).astype(np.float32))


@dataclass
class Trained:
    """A trained model, and the word counts it comes from: all words as a stored ``counts(word, c)``, tokens, distinct ones, texts."""

    model: Model
    counts: DataFrame
    tokens: int
    distinct: int
    texts: int


def trained(docs: DataFrame, rounds: int = ROUNDS) -> Trained:
    """Learns from ``docs(doc_id, text)`` outside fold 0: predictors from all of it, the mixer from its fold ``TUNING``, which the predictors have not seen by then."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), fold().alias("fold")).filter("fold <> 0")
    counts = stored(word_counts(rows))
    c = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    texts = rows.count()
    code = _code(counts, texts, int(c.n))
    seen = stored(context_counts(rows.select("text", (F.col("fold") == TUNING).alias("tuning")), code))
    model = start(code, _predictions(seen.filter("NOT tuning")))
    for _ in range(rounds):
        model = tuned(rows.filter(F.col("fold") == TUNING), model)
    model = replace(model, table=_predictions(seen))
    return Trained(model, counts, int(c.n) + texts, int(c.v) + (texts > 0), texts)


def scores(docs: DataFrame, by: Trained) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` per row of ``docs(doc_id, text)``.

    ``score`` is the model's log10 probability of the text as tokens and an end; ``base_score`` that of smoothed word counts. Rows are scored on their own, each from the same model.
    Words without a code get their counts by a join.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(by.model)
    over, end = math.log10(by.tokens + 0.1 * (by.distinct + 1)), math.log10(by.texts + 0.1)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            tokens, coded, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            rare: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
            for own, some in _sliced(batch.column(1), SLICE):
                told = tell(held.value, some)
                tokens[own], coded[own], base[own], score[own] = told.tokens, told.coded, told.base, told.state.score / math.log(10)
                for i, words in zip(own.tolist(), told.rare, strict=True):
                    rare[i] = words
            upto = np.cumsum([0] + [len(r) for r in rare])
            listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(rare).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(tokens), pa.array(coded), pa.array(base), pa.array(score), listed],
                ["doc_id", "n_bytes", "n_tokens", "coded", "base", "score", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stored(texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, coded long, base double, score double, rare array<long>")
                  .withColumn("row", F.monotonically_increasing_id()))
    held.destroy()
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = (rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n")).join(by.counts, "word", "left")
            .groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("rare_base")))
    known = F.col("coded") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(by.texts > 0))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(over)
    size = F.col("n_bytes") + 1  # the end counts as a byte
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"),
        F.lit(by.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes",
        (-F.col("score") * math.log2(10) / size).alias("bits_per_byte"))


def report(docs: DataFrame) -> DataFrame:
    """Scores of ``docs(doc_id, text)`` by a model of the rows outside fold 0.

    A null text is empty and has its end only. A row without ``doc_id`` is scored, but neither learned from nor held out. Repeated rows count and are scored
    each. With nothing to learn from the predictors say nothing, and ``base_score`` is 0. Other columns are not read. Hashes of words have 64 bits.
    """
    return scores(docs, trained(docs))
