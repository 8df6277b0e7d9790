"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sawlog.llm.common import Words, mixed, narrow, pieces, rolling, stored
from sawlog.llm.components import connected_components

MINIMA = 240
MISSED = 1e-5  # chance, at most, that a pair at the threshold shares no band
BITS = 4  # low bits kept of each minimum
BLOCK = 128  # documents compared with each other in one task
SIGMAS = 6


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] | np.uint64(1)).astype(np.uint32), seeds[n:].astype(np.uint32)


_A, _B = _parameters(MINIMA)


def rows_per_band(percent: int) -> int:
    """As many minima to a band as the threshold allows: 6 (so 40 bands) from 80 % on, fewer below."""
    share = percent / 100
    return max([r for r in (2, 3, 4, 5, 6) if (1 - share**r) ** (MINIMA // r) < MISSED], default=1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[None, i : i + 1024] * _A[:, None] + _B[:, None]
        # A multiply leaves low bits weak; fold the high ones into them.
        out = np.minimum(out, (y ^ (y >> np.uint32(15))).min(axis=1))
    return out


def packed(signature: np.ndarray) -> np.ndarray:
    """Low ``BITS`` bits of the minima, two to a byte."""
    low = (signature & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return low[::2] << BITS | low[1::2]


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: equal slots, less those equal by chance."""
    other = one[None, :] ^ many
    equal = ((other & 15) == 0).sum(axis=1) + ((other >> 4) == 0).sum(axis=1)
    chance = 0.5**BITS
    return (equal / (2 * many.shape[1]) - chance) / (1 - chance)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, whose letters A-Z are lowered."""
    for a, b in pieces(texts):
        words = Words([t.lower() for t in texts[a:b]])
        rolled = rolling(words.hash, width, 1)
        for first, count in zip(words.first, words.count, strict=True):
            if count >= width:
                yield np.unique(rolled[first : first + count - width + 1])
            elif count:
                yield rolling(words.hash[first : first + count], int(count), 1 + int(count))
            else:
                yield np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """Per document: set size, a 128-bit digest of the set, and the band keys."""

    bands = MINIMA // rows

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch):
                out = []
                for s in shingle_sets(texts, width):
                    if len(s):
                        m = minima(s)[: bands * rows].reshape(bands, rows).astype(np.uint64)
                        keys = np.arange(bands, dtype=np.uint64)
                        for j in range(rows):
                            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
                        out.append((len(s), int(_signed(s.sum(keepdims=True))[0]),
                                     int(_signed(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True))[0]), _signed(keys)))
                    else:
                        out.append((0, 0, 0, None))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                     pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"])

    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """A batch of (id, binary) in parts of bounded bytes; null is empty."""
    texts = [t or b"" for t in batch.column(1).to_pylist()]
    for a, b in pieces(texts, limit):
        yield batch.column(0).slice(a, b - a), texts[a:b]


class Block:
    """Some documents with their sets, compared with one of them at a time."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets])
        self.bits = np.stack([packed(minima(s)) for s in sets])
        share = percent / 100
        chance = 0.5**BITS
        seen = share + (1 - share) * chance
        self.least = share - SIGMAS * (seen * (1 - seen) / len(_A)) ** 0.5 / (1 - chance)

    def linked(self, one: np.ndarray, bits: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of ``among`` reach the threshold with the set ``one``: by bit counts, then on full sets."""
        small, large = np.minimum(self.size[among], len(one)), np.maximum(self.size[among], len(one))
        among = among[100 * small >= self.percent * large]
        if len(among):
            among = among[estimates(bits, self.bits[among]) >= self.least]
        found = []
        for k in among:
            s = self.sets[k]
            place = np.minimum(np.searchsorted(one, s), len(one) - 1)
            both = int((one[place] == s).sum())
            if 100 * both >= self.percent * (len(one) + len(s) - both):
                found.append(k)
        return np.array(found, np.int64)


def forest(block: Block) -> list[tuple[int, int]]:
    """Links that connect what is connected: a member that has been reached isn't compared again."""
    left, out = np.arange(len(block.sets)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            k = queue.pop()
            new = block.linked(block.sets[k], block.bits[k], left)
            out += [(int(k), int(n)) for n in new]
            queue += list(new)
            left = np.setdiff1d(left, new, assume_unique=True)
    return out


_EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _within(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        block = Block([np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()], percent)
        return _edge_batch([(ids[a], ids[b]) for a, b in forest(block)])

    return run


def _across(percent: int):
    """Documents outside the largest component against one block: a link to each component found there."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = []
        if left.num_rows and right.num_rows:
            ids, of = right.column("doc_id").to_pylist(), np.array(right.column("label").to_pylist())
            block = Block([np.frombuffer(b, np.uint64) for b in right.column("shingles").to_pylist()], percent)
            for doc, label, shingles in zip(*(left.column(c).to_pylist() for c in ("doc_id", "label", "shingles")), strict=True):
                one = np.frombuffer(shingles, np.uint64)
                new = block.linked(one, packed(minima(one)), np.flatnonzero(of != label))
                seen = {}
                for k in new:
                    seen.setdefault(of[k], ids[k])
                pairs += [(doc, other) for other in seen.values()]
        return _edge_batch(pairs)

    return run


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch.select([0, 1])):
                yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, shingles binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Groups of documents that reach each other by links of ``percent`` Jaccard similarity.

    Returns ``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``. Only these two
    columns are read, so others may have any name. Sets are distinct word shingles of ``width`` words; a
    shorter text is one shingle; an empty or null text has none and is linked with nothing. Rows that share
    a ``doc_id`` are one node; a row without ``doc_id`` is in no group (``component_id`` null) and kept.

    1. MinHash: 240 minima per set give 40 band keys (more and shorter ones below 80 %). Documents with equal sets become one class.
    2. Members of a band bucket are linked to its smallest member only; the components of these
       stars hold every candidate pair without writing pairs.
    3. Each such component is compared in blocks of bounded size: bit counts of the packed low bits of the
       minima estimate similarity, corrected for chance; those within six deviations of the
       threshold are settled on full sets. A member that has been reached is not compared again.
    4. Where a component fills several blocks, members outside its largest group meet every block.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, width, rows_per_band(percent)))
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n_shingles", "doc_id"], "left_semi")
    # Stars: every member of a bucket to its smallest.
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    # Stored, so that the join has two plain sides, of which Spark can split a hot one.
    centres = stored(keyed.groupBy("band").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last")).filter("v < last").select("band", "v"))
    stars = keyed.join(centres, "band").filter("doc_id > v").select(F.col("doc_id").alias("u"), "v").distinct()
    groups = connected_components(stars)
    # Blocks of bounded size: as many as the counted members of a component need.
    sized = narrow(stored(groups.groupBy("component").agg(F.count("*").alias("size"))))
    blocks = F.ceil(F.col("size") / F.lit(block * 3 // 4)).cast("long")
    members = stored(groups.join(sized, "component").select(
        F.col("node").alias("doc_id"), "component", blocks.alias("blocks"),
        F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(F.lit(0)).alias("block")))
    n_members = members.count()
    wanted = docs.join(narrow(members.select("doc_id"), n_members), "doc_id", "left_semi")
    sets = stored(_sets(wanted, width).join(narrow(members, n_members), "doc_id").dropDuplicates(["doc_id", "shingles"]))
    edges = stored(sets.groupBy("component", "block").applyInArrow(_within(percent), _EDGES))
    links = edges
    wide = sets.filter("blocks > 1")
    if wide.select("component").head(1):
        links = edges.unionByName(_cross_links(wide, edges, percent))
    # Copies belong to the group of their class.
    found = connected_components(links)
    rep_of = full.join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "rep")
    tied = stored(rep_of.filter("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
                  .unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    groups = connected_components(tied)
    return signed.select("doc_id", "n_shingles").join(
        groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _cross_links(wide: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of one candidate component.

    First one member of each group found meets those of the other groups, in blocks again; what then
    stands outside the largest group is compared with every block. Of two documents in different
    groups one is outside, so no link between groups is left out.
    """
    found = connected_components(edges)
    labelled = stored(wide.join(found.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label"), "doc_id", "left")
                      .withColumn("label", F.coalesce("label", "doc_id")))
    sizes = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    leaders = labelled.filter("doc_id = label").join(sizes.filter("n > 1"), ["component", "label"])
    meeting = stored(leaders.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("blocks") / 8).cast("long")))
                     .groupBy("component", "block").applyInArrow(_within(percent), _EDGES))
    joined = connected_components(edges.unionByName(meeting))
    labelled = stored(labelled.drop("label").join(joined.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label"), "doc_id", "left")
                      .withColumn("label", F.coalesce("label", "doc_id")))
    sizes = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    largest = narrow(stored(sizes.groupBy("component").agg(F.max(F.struct("n", "label")).alias("top")).select(
        "component", F.col("top.label").alias("top"))))
    outside = labelled.join(largest, "component").filter("label != top").drop("top")
    # Outside members in chunks, each sent to every block of its component.
    per_task = narrow(stored(outside.groupBy("component").agg(F.count("*").alias("n")).select(
        "component", F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("chunks"))))
    columns = ["component", "block", "chunk", "doc_id", "label", "shingles"]
    left = (outside.join(per_task, "component").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("chunks")))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(columns))
    right = (labelled.join(per_task, "component")
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(columns))
    keys = ["component", "block", "chunk"]
    # Both sides come from one table; new columns keep them apart.
    left, right = (side.select(*(F.col(c).alias(c) for c in columns)) for side in (left, right))
    pairs = left.groupBy(keys).cogroup(right.groupBy(keys))
    return stored(meeting.unionByName(pairs.applyInArrow(_across(percent), _EDGES)))
