"""Secret scans: fixed patterns, and a pair of character Markov chains.

Patterns find assigned passwords and keys, access key ids and long hexadecimal runs,
leftmost and non-overlapping for each kind. Besides, every run of at least MIN_TOKEN
key characters is judged by two first-order chains, one of random strings and one of
ordinary identifiers: a run whose transitions are more likely random by MIN_RATIO nats
or more, and that has MIN_DISTINCT characters or more, is a secret of kind 'random'.

The chains are trained on labelled tokens of at most about SAMPLE_DOCS documents: what
the patterns find is random, every other run of key characters is ordinary. The chain of
random strings gives half its weight to all characters alike, as the patterns' secrets
don't cover every alphabet. Their counts are one table of at most 2 x 65 x 65 rows.

Scanning is expressions on one row: no shuffle, no Python.

Cases: null text counts as empty and has no spans; positions are code points, the end
exclusive; spans of one start are ordered as the kinds are listed, and a 'random' run
that meets another span is left out; null or repeated doc_ids are rows of their own; an
empty table gives no rows; without any labelled token the chains are even and find
nothing; very long texts are scanned whole, in time in proportion to their length; other
columns, whatever their names, are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let, running_totals
from .shared import documents, quoted

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
TRAIN_TOKEN = r"[A-Za-z0-9+/_=-]{8,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")
SAMPLE_DOCS = 4000
MIN_RATIO, MIN_DISTINCT = 16.0, 8
#: How many transitions the ordinary chain's fall-back is worth: single runs, secrets perhaps, teach it little.
BACKOFF = 1000
MASK = "[SECRET]"
_NONE = "array<struct<start:int,kind:int,end:int>>"


def located(text: Column, pattern: str, kind: int, fits=None) -> Column:
    """Spans (start, kind, end) of a pattern's matches. fits(k, match): whether match k counts."""

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        lengths = F.transform(found, lambda x: F.length(x))

        def placed(g: Column, n: Column) -> Column:
            before = running_totals(F.transform(n, lambda x, k: x + F.get(g, k)))
            every = let(before, lambda b: F.transform(found, lambda x, k: F.struct((F.get(b, k) + F.get(g, k)).alias("start"), F.lit(kind).alias("kind"), (F.get(b, k) + F.get(g, k) + F.length(x)).alias("end"), fits(k, x).alias("fits") if fits else F.lit(True).alias("fits"))))
            return F.transform(F.filter(every, lambda s: s["fits"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

        return let(gaps, lambda g: let(lengths, lambda n: placed(g, n)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.array().cast(_NONE)))


def base_spans(text: Column) -> Column:
    assigned = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    by_assign = let(assigned, lambda a: F.when(F.size(a) > 0, located(text, ASSIGN, 0, lambda k, _: F.length(F.get(a, k)) >= MIN_ASSIGNED)).otherwise(F.array().cast(_NONE)))
    by_access = F.when(text.contains("AKIA"), located(text, ACCESS, 1)).otherwise(F.array().cast(_NONE))
    return F.array_sort(F.concat(by_assign, by_access, located(text, HEX, 2)))


def steps(token: Column) -> Column:
    """Numbers of a token's characters, from 1."""
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of characters."""
    n = docs.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = docs.where(part < min(1.0, sample_docs / max(1, n))).select(text.alias("text"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    every = lambda x, pattern, group=0: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    found = F.concat(F.filter(every(F.col("text"), ASSIGN, 2), lambda a: F.length(a) >= MIN_ASSIGNED), every(F.col("text"), ACCESS), every(F.col("text"), HEX))
    labelled = sample.select(F.explode(F.array(F.struct(F.lit(1).alias("y"), found.alias("t")), F.struct(F.lit(0).alias("y"), every(rest, TRAIN_TOKEN).alias("t")))).alias("s"))
    tokens = labelled.select("s.y", F.explode("s.t").alias("token"))
    pairs = let(steps(F.col("token")), lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda k: F.struct(F.get(s, k).alias("a"), F.get(s, k + 1).alias("b"))))
    counts = tokens.where(F.length("token") > 1).select("y", F.explode(pairs).alias("p")).where("p.a > 0 AND p.b > 0").groupBy("y", "p.a", "p.b").count().collect()
    size = len(ALPHABET)
    c = [[[0] * size for _ in range(size)] for _ in (0, 1)]
    for r in counts:
        c[r["y"]][r["a"] - 1][r["b"] - 1] = r["count"]
    if not counts:
        return [0.0] * (size * size)
    # ordinary transitions fall back on how common the character is in ordinary tokens
    seen = [sum(c[0][a][b] for a in range(size)) for b in range(size)]
    common = [(n + 0.5) / (sum(seen) + 0.5 * size) for n in seen]
    out = []
    for a in range(size):
        n0, n1 = sum(c[0][a]), sum(c[1][a])
        for b in range(size):
            ordinary = (c[0][a][b] + BACKOFF * common[b]) / (n0 + BACKOFF)
            random = 0.5 * (c[1][a][b] / n1 if n1 else 1 / size) + 0.5 / size
            out.append(round(math.log(random / ordinary), 6))
    return out


def random_spans(text: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    size = len(ALPHABET)

    def unlike(_, token: Column) -> Column:
        def ratio(s: Column) -> Column:
            each = F.transform(s, lambda a, k: F.coalesce(F.get(table, (a - 1) * size + F.get(s, k + 1) - 1), F.lit(0.0)))
            return (F.size(F.array_distinct(s)) >= MIN_DISTINCT) & (F.aggregate(each, F.lit(0.0), lambda x, y: x + y) >= MIN_RATIO)

        return let(steps(token), ratio)

    return located(text, TOKEN, 3, unlike)


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, text (null as empty), base and spans: arrays of (start, kind, end), kind a place in KINDS."""
    text = F.col("text")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("doc_id", "text", base_spans(text).alias("base"), random_spans(text, ratios).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with a mask for each stretch that spans, in order of start, cover."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.when(new, F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    rebuilt = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rebuilt).otherwise(text)


def redact(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs, all columns, with every span of text masked; null texts stay null."""
    found = scan(docs.select(F.struct(*quoted(docs.columns)).alias("doc_id"), "text"), ratios)
    new = F.when(F.col("doc_id.text").isNotNull(), masked(F.col("text"), F.col("spans")))
    return found.select(*(new.alias("text") if c == "text" else F.col("doc_id")[c].alias(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
