"""Packing of tokenized documents into sequences by best-two-fit."""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import Seen, pieces, stored

GROUP = 100_000  # pieces packed in one task
CACHE = 300_000  # words whose ids a worker remembers
TEXTS = 1_000  # rows that a task is handed together
SLICE = 2 << 20  # bytes of text tokenized at once
JOINED = 32  # words that the tokenizer gets in one text
ENCODED = 5_000  # new words encoded at once, as what the tokenizer returns is large
LONG = 10_000  # characters beyond which a word is not remembered
SHIFT = 33  # bits of a sequence number below its group


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<" not in text


class WordIds:
    """Ids of texts by their words.

    For tokenizers that put texts into composed lower case, split at white space first and then between letters and other
    characters: there a text's ids are those of its words in turn. Words are told apart once per batch, and ids of words are remembered
    from batch to batch, at most ``CACHE``, those met again before others. Plain texts are put into lower case before, and their full stops and commas taken off, as the tokenizer does
    itself; that leaves fewer words.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        plain = special and all(t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in special.values())
        #: A token that parts words, and its text; none where words next to it might be read differently.
        self.mark, self.sign = min((k, t.content) for k, t in special.items()) if plain else (None, "")
        #: No special token begins inside a word without these.
        self.openers = "[" + "".join(re.escape(c) for c in sorted({t.content[0] for t in special.values()})) + "]" if plain else ""
        self._forget()

    def _forget(self) -> None:
        self.seen = Seen(CACHE)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _words(self, texts: pa.Array) -> pa.ListArray:
        plain = pa.array([_latin(t) for t in texts.to_pylist()], pa.bool_())
        # A mark between a letter and white space is a token of its own; after another mark it would not be.
        lower = pc.replace_substring_regex(pc.utf8_lower(texts), r"([a-zß-öø-ÿ])([.,])([ \n])", r"\1 \2\3")
        texts = pc.if_else(plain, lower, texts)
        for space in "\n", "\t", "\r":
            texts = pc.replace_substring(texts, space, " ")
        return pc.split_pattern(texts, " ")

    def _alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [code.ids for code in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes.sum()))

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all. Words go in together with a mark after each; those that may hold a special token go alone."""
        if self.mark is None:
            return self._alone(words)
        alone = pc.match_substring_regex(words, self.openers)
        sign = pa.scalar(self.sign, words.type)
        edges = pa.array([*range(0, len(words), JOINED), len(words)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(edges, pc.if_else(alone, pa.scalar("", words.type), words)), sign)
        ids = self._alone(pc.binary_join_element_wise(texts, sign, pa.scalar("", words.type)))[1]
        marked = ids == self.mark
        sizes = np.diff(np.flatnonzero(marked), prepend=-1) - 1
        ids, alone = ids[~marked], np.asarray(alone)
        if alone.any():
            own, rest = self._alone(words.filter(pa.array(alone)))
            ids = np.insert(ids, np.repeat((np.cumsum(sizes) - sizes)[alone], own), rest)
            sizes[alone] = own
        return sizes, ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where those of each text end."""
        lists = self._words(texts)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, np.asarray(coded.indices)
        at, new, kept = self.seen.numbers(words)
        if kept is not None:
            staying = np.zeros(len(self.sizes), bool)
            staying[kept] = True
            self.ids, self.sizes = self.ids[np.repeat(staying, self.sizes)], self.sizes[kept]
        fresh, longest = words.take(pa.array(new)), 0
        for at_once in range(0, len(new), ENCODED):
            some = fresh.slice(at_once, ENCODED)
            longest = max(longest, pc.max(pc.utf8_length(some)).as_py())
            sizes, ids = self._encoded(some)
            self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)
        start = np.cumsum(self.sizes) - self.sizes
        each = self.sizes[at][codes]
        ends = np.cumsum(each)
        ids = self.ids[np.repeat(start[at][codes] - (ends - each), each) + np.arange(int(each.sum()))]
        upto = np.concatenate([[0], ends])[np.asarray(lists.value_lengths()).cumsum()]
        if longest > LONG:
            self._forget()  # very long words are not carried along
        return ids, upto


_encoders: dict[str, WordIds] = {}


def tokenized(docs: DataFrame, path: str, length: int, end_id: int, digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: the ids of a text, then ``end_id``, cut every ``length`` ids.

    Returns ``doc_id, piece, start, length`` and ``ids`` (binary), or ``digest`` of them in their place. A null text
    has the end id only. Nothing is shuffled.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        encode, end = _encoders[path], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in pieces(pc.binary_length(texts).to_pylist(), SLICE):
                ids, upto = encode(texts.slice(a, b - a))
                row, piece, size, out, before = [], [], [], [], 0
                for i, after in enumerate(upto.tolist(), a):
                    whole = ids[before:after].tobytes() + end
                    before = after
                    for k, at in enumerate(range(0, len(whole), 4 * length)):
                        part = whole[at : at + 4 * length]
                        row.append(i)
                        piece.append(k)
                        size.append(len(part) // 4)
                        out.append(digest(part) if digest else part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array([k * length for k in piece], pa.int64()),
                     pa.array(size, pa.int64()), pa.array(out, pa.int64() if digest else pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])
        pa.default_memory_pool().release_unused()

    kind = "long" if digest else "binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, piece int, start long, length long, ids {kind}")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    A bin is filled greedily with the largest items that fit. Then its smallest item gives way to the two unpacked
    items that together fill its place and the gap best, if they fill it better. Items of one length are
    alike, so the choice is among lengths: a bit set of those left answers what fits best.
    """
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    top = np.cumsum(count)  # items of a length are taken from the end of their run
    upto = [(1 << (gap + 1)) - 1 for gap in range(capacity + 1)]
    present = sum(1 << int(size) for size in np.flatnonzero(count))
    sizes: np.ndarray | None = None  # lengths left, ascending
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0

    def move(size: int, by: int) -> None:
        nonlocal present, sizes
        before = count[size] > 0
        count[size] += by
        if before != (count[size] > 0):
            present ^= 1 << size
            sizes = None

    while present:
        gap, held = capacity, []
        while size := max(0, (present & upto[gap]).bit_length() - 1):
            move(size, -1)
            held.append(size)
            gap -= size
        if gap and present:
            if sizes is None:
                sizes = _bits(present)
            room = gap + held[-1]
            first = sizes[: np.searchsorted(sizes, room)]
            partner = np.searchsorted(first, room - first, "right") - 1
            # A length is its own partner only if two items have it; else the next smaller one is.
            partner -= (partner == np.arange(len(first))) & (count[first] < 2)
            both = np.where(partner >= 0, first + first[partner], 0) if len(first) else np.zeros(1, np.int64)
            best = int(both.argmax())
            if both[best] > held[-1]:
                move(held.pop(), 1)
                held += [int(first[best]), int(first[partner[best]])]
                move(held[-2], -1)
                move(held[-1], -1)
        at = 0
        for size in held:
            top[size] -= 1
            where[order[top[size]]], offset[order[top[size]]] = number, at
            at += size
        number += 1
    return where, offset


def _bits(mask: int) -> np.ndarray:
    raw = np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def packed(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """``pieces`` (a stored frame with ``length``) and their ``sequence_id`` and ``offset``.

    Pieces are dealt evenly, whatever their keys, into as many groups as the counted rows need; a group is packed in one task, so memory
    is bounded and only the last sequences of a group are left unfilled. Full pieces are sequences as they are.
    """
    groups = max(1, -(-pieces.count() // group))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = np.asarray(table.column("length"))
            where, offset = best_two_fit(lengths, capacity)
            base = table.column("dealt")[0].as_py() << SHIFT
            table = table.drop_columns(["dealt"]).append_column("sequence_id", pa.array(where + base, pa.int64())).append_column(
                "offset", pa.array(offset, pa.int64()))
            yield from table.to_batches(max_chunksize=10_000)

    schema = pieces.schema.simpleString()[len("struct<"):-1]
    return pieces.repartition(groups).withColumn("dealt", F.spark_partition_id()).mapInArrow(
        run, schema + ",sequence_id:bigint,offset:bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1,
                   digest: Callable[[bytes], int] | None = None) -> DataFrame:
    """All of ``docs(doc_id, text)`` in sequences of at most ``capacity`` ids.

    Returns a row per piece: ``doc_id, piece, start, length, ids, sequence_id, offset``. Only documents of more ids are cut. Each row of ``docs`` is
    packed, repeated rows too; a null ``doc_id`` stays null; other columns are not read. With ``digest``, ids are summed up at
    once and never shuffled; without, they travel with their pieces.
    """
    return packed(stored(tokenized(docs, path, capacity, end_id, digest), TEXTS), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ids joined in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


crc32 = zlib.crc32
