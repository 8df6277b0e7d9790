"""Conversations put into reply order by the passages that messages quote."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sawlog.llm.common import stored

_MARKS = re.compile(r"[ \t]*>(?:[ \t]*>)*[ \t]?")
_SPACE = re.compile(r"\s+")
ATTRIBUTION = re.compile(r"^On .{1,200} wrote:\s*$")
LEAST = 4  # characters of a passage that can be linked
WHOLE, PARAGRAPH, LINE = 0, 1, 2


def _unit(text: str) -> bytes | None:
    """The digest of a passage without case and with single spaces; none if it is too short."""
    plain = _SPACE.sub(" ", text).strip().lower()
    return hashlib.blake2b(plain.encode(), digest_size=16).digest() if len(plain) >= LEAST else None


def units(lines: list[str]) -> dict[bytes, int]:
    """Digests of a passage as a whole, of its paragraphs, and of its lines; the largest unit of each digest."""
    found: dict[bytes, int] = {}
    paragraphs = [p for p in re.split(r"\n[ \t]*\n", "\n".join(lines)) if p.strip()]
    for size, texts in ((WHOLE, ["\n".join(lines)]), (PARAGRAPH, paragraphs), (LINE, lines)):
        for text in texts:
            if (digest := _unit(text)) is not None:
                found.setdefault(digest, size)
    return found


def parsed(text: str) -> tuple[str, dict[bytes, int], list[tuple[int, dict[bytes, int]]]]:
    """A message without quotes, its own units, and its quoted passages as (level, units) in order.

    The level of a line is the number of ``>`` it starts with; neighbouring lines of one level are one passage.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.replace("\r\n", "\n").split("\n"):
        marks = _MARKS.match(line)
        level = marks[0].count(">") if marks else 0
        if not level:
            own.append(line)
        else:
            if level != before:
                if before == 0 and own and ATTRIBUTION.match(own[-1]):
                    own.pop()
                passages.append((level, []))
            passages[-1][1].append(line[marks.end():])
        before = level
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if passages else text
    return clean, units(own), [(level, units(lines)) for level, lines in passages]


_PARSED = ("conv_id long, turn long, tag int, role string, text string, own array<binary>, n_quotes int, "
           "quotes array<struct<block: int, level: int, size: int, unit: binary>>")


def _parse(batches):
    kind = pa.list_(pa.struct([("block", pa.int32()), ("level", pa.int32()), ("size", pa.int32()), ("unit", pa.binary())]))
    for batch in batches:
        read = [parsed(t or "") for t in batch.column("text").to_pylist()]
        quotes = [[{"block": b, "level": level, "size": size, "unit": unit} for b, (level, found) in enumerate(q) for unit, size in found.items()]
                  for _, _, q in read]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "tag", "role")), pa.array([r[0] for r in read], pa.string()),
             pa.array([list(r[1]) for r in read], pa.list_(pa.binary())), pa.array([len(r[2]) for r in read], pa.int32()), pa.array(quotes, kind)],
            ["conv_id", "turn", "tag", "role", "text", "own", "n_quotes", "quotes"])


def linked(messages: DataFrame) -> DataFrame:
    """Messages in reply order, without quotes.

    Returns a row per row of ``messages(conv_id, turn, role, text)``: these four, the text without quoted lines, and ``parent_turn`` (the message it
    replies to, or null), ``thread`` (the turn that its chain of replies starts from), ``depth`` (replies above it), ``n_quotes`` and
    ``n_linked`` (quoted passages, and those found). Sorting by ``conv_id, thread, turn`` gives conversations in reply order.

    Quoted passages are hashed, without case and spacing, as a whole, by paragraph and by line, and joined to the earliest message of the conversation
    that has the passage as its own text and comes before the quoting one; the largest unit decides, then the later message. A message replies to what it
    quotes at the lowest level; quotes that are found nowhere link nothing. A null text is empty; rows without ``conv_id`` or ``turn`` link nothing and are their own thread;
    rows that share a turn share its parent: the latest of theirs. Other columns are not read.

    A conversation is never gathered: passages are reduced to their earliest turn before they are shuffled, and chains are followed
    by doubling steps over turns.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.hash("role", "text").alias("tag"), "role", "text")
    rows = stored(rows.mapInArrow(_parse, _PARSED))
    named = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    origins = named.select("conv_id", "turn", F.explode("own").alias("unit")).groupBy("conv_id", "unit").agg(F.min("turn").alias("origin"))
    key = ["conv_id", "turn", "tag"]
    quotes = named.filter("n_quotes > 0").dropDuplicates(key).select(*key, F.explode("quotes").alias("q")).select(*key, "q.*")
    found = quotes.join(origins, ["conv_id", "unit"]).filter("origin < turn")
    blocks = found.groupBy(*key, "block", "level").agg(F.min(F.struct("size", (-F.col("origin")).alias("back"))).alias("best"))
    parents = stored(blocks.groupBy(key).agg(
        F.count("*").cast("int").alias("n_linked"), F.min(F.struct("level", F.col("best.back").alias("back"))).alias("best")).select(
        *key, "n_linked", (-F.col("best.back")).alias("parent")))
    steps = parents.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent_turn"))
    chains = followed(steps)
    out = rows.select(*key, "role", "text", "n_quotes").join(parents.select(*key, "n_linked"), key, "left").join(chains, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", "parent_turn", F.coalesce("top", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def followed(steps: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, top, depth`` of replies ``(conv_id, turn, parent_turn)``; each round doubles the reach."""
    chains = stored(steps.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("top"), F.lit(1).alias("depth")))
    while True:
        ahead = chains.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        if not chains.join(ahead, ["conv_id", "top"], "left_semi").head(1):
            return chains
        chains = stored(chains.join(ahead, ["conv_id", "top"], "left").select(
            "conv_id", "turn", "parent_turn", F.coalesce("next", "top").alias("top"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def chat(replies: DataFrame) -> DataFrame:
    """Linked messages as chat turns, in reply order: partitions are ranges, so one after the other they read as conversations."""
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return replies.select("conv_id", "thread", "turn", turn.alias("chat")).repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions(
        "conv_id", "thread", "turn")
