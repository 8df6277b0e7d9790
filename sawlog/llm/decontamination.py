"""Benchmark passages in documents, found by winnowing."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.llm.common import KEY, keyed, narrow, stored, text_or_empty

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4  # words hashed together
ITEM_WORDS = 2_000_000  # benchmark words that may be broadcast


def words(text: Column) -> Column:
    """Words of a text whose letters A-Z are lowered."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def _paired(a: Column, b: Column, step: int, f) -> Column:
    """``f(a[i], b[i + step])`` for all ``i`` that both have."""
    n = F.greatest(F.size(b) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, step + 1, n), f)


def with_grams(df: DataFrame, width: int) -> DataFrame:
    """Adds ``g<width>``: hashes of every ``width`` neighbouring ``words``, made from shorter ones."""
    if f"g{width}" in df.columns:
        return df
    if width == 1:
        return df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    half = width // 2
    df = with_grams(with_grams(df, half), width - half)
    return df.withColumn(f"g{width}", _paired(F.col(f"g{half}"), F.col(f"g{width - half}"), half, lambda a, b: F.xxhash64(a, b)))


def with_fingerprints(df: DataFrame, length: int) -> DataFrame:
    """Adds ``f<length>``: the smallest gram of each ``length`` neighbouring words, without repeats.

    Whoever shares that many words shares the smallest gram among them.
    """
    gram = min(GRAM, length)
    df = with_grams(df, gram)
    width, name = 1, f"g{gram}"
    while width < length - gram + 1:
        step = min(width, length - gram + 1 - width)
        df = df.withColumn(f"m{length}_{width + step}", _paired(F.col(name), F.col(name), step, lambda a, b: F.least(a, b)))
        width, name = width + step, f"m{length}_{width + step}"
    return df.withColumn(f"f{length}", F.array_distinct(name))


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """Words of documents within a passage of ``length`` words that a benchmark item has too.

    Returns per row of ``docs(doc_id, text)``: the key of ``keyed``, ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.
    ``benchmark`` has ``item_id, text``; an item of fewer words is a passage as a whole; one without words has none. Only these
    columns are read. A null text has no words; rows without ``doc_id`` are checked like others. Repeated items count once; an item without ``item_id``
    marks words but isn't counted.

    Winnowing: of every window of grams the smallest hash is kept, so a shared passage always shares a fingerprint.
    Fingerprints of all documents meet those of the benchmark; each hit is extended along its diagonal by comparing words.
    All of it is column functions, and a text is never shuffled where the documents hit are few enough to be broadcast.
    """
    docs = keyed(docs)
    items = stored(benchmark.select("item_id", words(text_or_empty()).alias("words"))
                   .filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(length)))
                   .withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item", "item_id"]))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most ``length`` values
    scan = docs.select(*KEY, "doc_id", words(F.col("text")).alias("words"))
    marks = []
    for n in lengths:
        scan = with_fingerprints(scan, n)
        own = with_fingerprints(items.filter(F.col("length") == n), n)
        gram = f"g{min(GRAM, n)}"
        marks.append(own.select("item", "length", F.size("words").alias("n_item"), f"f{n}", F.posexplode(gram).alias("at", "mark"))
                     .filter(F.array_contains(f"f{n}", F.col("mark"))).drop(f"f{n}"))
    kept = F.array(*[F.struct(F.lit(n).alias("length"), F.col(f"f{n}").alias("marks")) for n in lengths]) if lengths else F.array().cast(
        "array<struct<length:int,marks:array<bigint>>>")
    scan = stored(scan.select(*KEY, "doc_id", F.size("words").cast("long").alias("n_words"), kept.alias("kept")))
    result = scan.select(*KEY, "doc_id", "n_words")
    if not lengths:
        found = result.select(*KEY, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    else:
        found = _extended(docs, scan, items, _union(marks), lengths)
    ids = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return result.join(narrow(stored(found)), KEY, "left").select(
        *KEY, "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _extended(docs: DataFrame, scan: DataFrame, items: DataFrame, marks: DataFrame, lengths: list[int]) -> DataFrame:
    marks = stored(marks)
    each = scan.select(*KEY, F.explode("kept").alias("k")).select(*KEY, F.col("k.length").alias("length"), F.explode("k.marks").alias("mark"))
    hits = stored(each.join(narrow(marks), ["length", "mark"]).groupBy(KEY).agg(
        F.collect_set(F.struct("item", "length", "n_item", "at", "mark")).alias("hits")))
    held = docs.select(*KEY, "text").join(narrow(hits.select(KEY)), KEY, "left_semi").dropDuplicates(KEY).join(hits, KEY)
    held = held.select(*KEY, "hits", words(F.col("text")).alias("words"))
    grams = sorted({min(GRAM, n) for n in lengths})
    for n in grams:
        held = with_grams(held, n)

    def places(h: Column) -> Column:
        """Where the document has the mark: the diagonals to look along, and the words there."""
        def among(g: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0))), lambda i: F.get(g, i) == h["mark"])

        out = None
        for n in reversed(grams):
            here = among(F.col(f"g{n}"))
            out = here if out is None else F.when(F.least(h["length"], F.lit(GRAM)) == n, here).otherwise(out)
        return F.transform(out, lambda p: F.struct(h["item"].alias("item"), h["length"].alias("length"), h["n_item"].alias("n_item"), (p - h["at"]).alias("d")))

    diagonals = held.select(*KEY, "words", F.array_distinct(F.flatten(F.transform("hits", places))).alias("ds"))
    skip = lambda d: F.greatest(d, F.lit(0))
    parts = F.transform("ds", lambda x: F.struct(x.alias("x"), F.slice(F.col("words"), skip(x["d"]) + 1, x["n_item"] - skip(-x["d"])).alias("part")))
    parts = diagonals.select(*KEY, F.explode(parts).alias("p")).select(*KEY, "p.x.item", "p.x.length", "p.x.d", "p.part")
    size = items.agg(F.sum(F.size("words"))).first()[0]
    held_items = items.select("item", "item_id", F.col("words").alias("item_words"))
    pairs = parts.join(F.broadcast(held_items) if size <= ITEM_WORDS else held_items, "item")
    same = F.zip_with("part", F.slice("item_words", skip(-F.col("d")) + 1, F.size("part")), lambda a, b: a == b)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("same") - F.col("length"), F.lit(0))),
                      lambda j: (F.size("same") >= F.col("length")) & F.forall(F.slice("same", j + 1, F.col("length")), lambda x: x))
    runs = pairs.withColumn("same", same).filter(F.size("same") >= F.col("length")).select(
        *KEY, "item_id", "length", skip(F.col("d")).alias("base"), starts.alias("starts")).filter(F.size("starts") > 0)
    covered = F.transform("starts", lambda j: F.sequence(F.col("base") + j, F.col("base") + j + F.col("length") - 1))
    return runs.select(*KEY, "item_id", F.array_distinct(F.flatten(covered)).alias("covered")).groupBy(KEY).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
