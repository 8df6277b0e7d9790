"""Secrets in texts: fixed forms, and random strings by character Markov models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sawlog.functions.binding import let
from sawlog.llm.common import text_or_empty

# The forms of secrets that are looked for by pattern. Shorter matches don't count.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more are the same matches as all runs without the shorter ones.
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
MODEL = "random"  # the kind of the spans that the models add
ALPHABET = "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
LEAST = 16  # characters of a candidate
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
SAMPLE_DOCUMENTS = 2_000  # about as many documents give the samples
SMOOTHING = 20.0
MARGIN = 12.0  # nats by which the random model must win,
RATE = 1.0  # and nats per character
_BLOCK = 256


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``start, end`` in code points, the end exclusive.

    Matches whose ``group`` has fewer than ``least`` characters are left out. Places come from the lengths of the
    matches and of the pieces between them, summed up by blocks.
    """

    def spans(found: Column, between: Column, measured: Column) -> Column:
        n = F.size(found)
        parts = F.zip_with(F.slice(between, 1, n), found, lambda gap, match: F.struct(
            F.char_length(gap).alias("gap"), F.char_length(match).alias("size")))
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))

        def placed(parts: Column, steps: Column) -> Column:
            sums = F.transform(blocks, lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
            before = let(sums, lambda s: F.transform(blocks, lambda b: _sum(F.slice(s, F.lit(1), b))))

            def place(before: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    block = F.floor(i / _BLOCK).cast("int")
                    start = F.get(before, block) + _sum(F.slice(steps, block * _BLOCK + 1, i % _BLOCK)) + x["gap"]
                    return F.struct(start.alias("start"), (start + x["size"]).alias("end"), (F.get(measured, i) >= least).alias("ok"))

                return F.filter(F.transform(parts, one), lambda s: s["ok"])

            return let(before, place)

        return let(parts, lambda p: let(F.transform(p, lambda x: x["gap"] + x["size"]), lambda steps: placed(p, steps)))

    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.char_length(m))
    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, pattern, -1), lambda between: let(lengths, lambda m: spans(found, between, m)))).otherwise(none))


def with_base(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``at_<kind>``: the places of each fixed form."""
    return df.withColumns({f"at_{kind}": located(text, pattern, group, least) for kind, (pattern, group, least) in KINDS.items()})


def _below(share: float) -> int:
    """The bound under which about this share of all 64-bit hashes lies; some do, however small it is."""
    return min(2**63 - 1, -(2**63) + max(1, int(share * 2**64)))


def samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled strings ``token, random`` from about ``documents`` documents, chosen by a hash of ``doc_id`` and text.

    Ordinary: words and identifiers that are no part of a fixed form, also in capitals; strings of both letters and digits have no label. Random: the secrets of the fixed forms, and for every ordinary
    string its SHA-256 in the usual writings (hexadecimal, base64, capitals and digits).
    """
    total = docs.count()
    chosen = F.lit(True) if total <= documents else F.xxhash64("doc_id", "text") < _below(documents / total)
    some = docs.filter(chosen).select(text_or_empty().alias("text"))
    forms = "|".join(pattern for pattern, _, _ in KINDS.values())
    cleaned = F.regexp_replace("text", forms, " ")
    ordinary = some.select(F.explode(F.regexp_extract_all(cleaned, F.lit(ORDINARY), F.lit(0))).alias("token")).filter(
        ~(F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")))
    values = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g, _ in KINDS.values()])
    secrets = some.select(F.explode(values).alias("token")).filter(F.char_length("token") >= 12)
    digest = F.sha2("token", 256)
    in_base64 = F.base64(F.unhex(digest))
    made = ordinary.distinct().select(F.explode(F.array(
        digest, in_base64, F.upper(F.substring(F.regexp_replace(in_base64, "[^A-Za-z0-9]", ""), 1, 20)),
        F.substring(F.regexp_replace(in_base64, "[^A-Za-z0-9]", ""), 1, 36))).alias("token"))
    both = ordinary.select(F.explode(F.array("token", F.upper("token"))).alias("token"))
    return both.withColumn("random", F.lit(False)).unionByName(secrets.unionByName(made).withColumn("random", F.lit(True)))


def log_ratios(labelled: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """The log-likelihood ratio of every pair of characters: random model less ordinary model.

    Pairs are counted in Spark; what comes back has at most two entries per pair of the alphabet. Smoothing draws each
    row of either model to equal chances, so an unseen pair favours neither.
    """
    pairs = F.transform(F.sequence(F.lit(2), F.char_length("token")), lambda i: F.substr("token", i - 1, F.lit(2)))
    counted = labelled.filter(F.char_length("token") >= 2).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    place, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    seen = {False: [[0.0] * n for _ in ALPHABET], True: [[0.0] * n for _ in ALPHABET]}
    for row in counted.collect():
        a, b = (place.get(c) for c in row.pair)
        if a is not None and b is not None:
            seen[row.random][a][b] += row["count"]

    def chance(label: bool, a: int, b: int) -> float:
        row = seen[label][a]
        return (row[b] + smoothing / n) / (sum(row) + smoothing)

    return [math.log(chance(True, a, b) / chance(False, a, b)) for a in range(n) for b in range(n)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string of the alphabet."""
    values = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    n = len(ALPHABET)

    def code(i: Column) -> Column:
        return F.position(F.substr(token, i, F.lit(1)), F.lit(ALPHABET)) - 1

    return F.aggregate(F.sequence(F.lit(2), F.char_length(token)), F.lit(0.0),
                       lambda acc, i: acc + F.get(values, code(i - 1) * n + code(i)))


def _outside(span: Column, held: Column) -> Column:
    """What spans of ``held`` leave of a span: ``start, end`` of every part long enough for a candidate."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def part(start: Column, end: Column) -> Column:
        return F.when(end - start >= LEAST, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)

    inside = F.array_sort(F.filter(held, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])))
    first = F.struct(span["start"].alias("done"), none.alias("parts"))
    return F.aggregate(inside, first, lambda acc, b: F.struct(
        F.greatest(acc["done"], b["end"]).alias("done"), F.concat(acc["parts"], part(acc["done"], b["start"])).alias("parts")),
        lambda acc: F.concat(acc["parts"], part(acc["done"], span["end"])))


def with_random(df: DataFrame, text: Column, table: list[float], margin: float = MARGIN) -> DataFrame:
    """Adds ``at_random``: candidate strings that the random model explains better by ``margin``; fixed forms are cut out of them first."""
    held = F.concat(*[f"at_{kind}" for kind in KINDS])
    wins = lambda s: let(F.substr(text, s["start"] + 1, s["end"] - s["start"]), lambda token: ratio(token, table) >= F.greatest(F.lit(margin), RATE * F.char_length(token)))
    return (df.withColumn("held", held).withColumn("loose", located(text, CANDIDATE))
            .withColumn("parts", F.flatten(F.transform("loose", lambda s: _outside(s, F.col("held")))))
            .withColumn(f"at_{MODEL}", F.filter("parts", wins)).drop("held", "loose", "parts"))


def _listed(kinds: list[str]) -> Column:
    """All spans by start, then by kind in the order listed."""
    return F.array_sort(F.concat(*[_numbered(kind, i) for i, kind in enumerate(kinds)]))


def _numbered(kind: str, number: int) -> Column:
    return F.transform(f"at_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, table: list[float], margin: float = MARGIN) -> DataFrame:
    """A row per row of ``docs(text, ...)``: ``row`` (its columns, whatever their names), ``scanned`` (its text), ``spans`` (an array of
    ``start, number, end, kind``) and one ``at_<kind>`` per kind.

    A null text is empty. Places count code points, ends are exclusive. Kinds may overlap; each finds its own matches from left to right.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("scanned"))
    return with_random(with_base(held, F.col("scanned")), F.col("scanned"), table, margin).withColumn("spans", _listed([*KINDS, MODEL]))


def trained(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Both models from the documents themselves: see ``samples``."""
    return log_ratios(samples(docs.select("doc_id", "text"), documents))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` per row of ``docs``."""
    found = find_secrets(docs.select("doc_id", "text"), trained(docs))
    counts = [F.size(f"at_{kind}").cast("long").alias(f"n_{kind}") for kind in (*KINDS, MODEL)]
    return found.select("row.doc_id", *counts, F.sha2(_written(_listed(list(KINDS))), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, table: list[float], mark: str = "<secret>", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans give one mark. A null text stays null."""
    found = find_secrets(docs, table, margin)
    start = F.struct(F.lit(0).alias("done"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        ahead = F.concat(acc["out"], F.substr("scanned", acc["done"] + 1, F.greatest(s["start"] - acc["done"], F.lit(0))),
                         F.when(s["start"] >= acc["done"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["done"], s["end"]).alias("done"), ahead.alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr("scanned", acc["done"] + 1, F.char_length("scanned")))

    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, cut, rest)).otherwise(F.col("row.text")).alias("text")
    return found.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
