"""Personal data: fixed patterns, and contexts learnt from what they find.

Base spans are what four patterns find: e-mail addresses, network addresses, payment card
numbers and telephone numbers, leftmost and non-overlapping for each kind.

From them, contexts are bootstrapped. The corpus' identifiers are its stretches of tokens
with a digit or an at sign. Base finds are the seeds; the words before an identifier (the
last one, and the last two) are its lexical patterns. Patterns and identifiers form a
graph that is scored in ROUNDS rounds by joins and sums: a pattern by the mean score of
the distinct identifiers that it meets, times its precision, the share of all occurrences
of its words in the corpus that an identifier follows; an identifier by how likely one of
its trusted patterns is right. A pattern needs MIN_SEEDS distinct seeds of a kind and
MIN_TRUST, an identifier MIN_SCORE. Identifiers so found that no base span covers are
spans of kind 'near_<kind>', where a trusted pattern stands before them.

All of it is expressions, joins and sums over whole tables; texts are never shuffled, and
what is found in a text comes back to its rows by a digest of the text.

Cases: null text counts as empty and has no spans; positions are code points, the end
exclusive; spans are in order of kind as listed, then start; an identifier that two kinds
claim gets the better scored, of equal ones the first; null or repeated doc_ids and
repeated texts are rows of their own (repeated texts count as often as they come for
precision, but their identifiers once); an empty table gives no rows; without seeds there
are base spans only; very long texts are scanned whole in time in proportion to their
length; other columns, whatever their names, are ignored by scan() and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let, running_totals
from .secrets import located, masked
from .shared import documents, keep, quoted

KINDS = ("email", "ip", "card", "phone")
NEAR = tuple(f"near_{k}" for k in KINDS)
#: The base patterns, written so that no match is tried twice from within one run of characters; the results are those of the plain forms.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9])++"
#: A stretch of tokens with a digit or an at sign, one blank between.
STRETCH = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
LEADING, TRAILING = r"^[^\p{L}\p{N}+]++", r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$"
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Characters before an identifier that are looked at for words.
REACH = 80
MIN_DIGITS, MIN_LENGTH = 4, 6
MIN_SEEDS, MIN_TRUST, MIN_SCORE, ROUNDS = 5, 0.4, 0.6, 3
SALTS = 32
MASK = "[PRIVATE]"
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The check sum of payment cards: every second digit from the right but one doubled, its digits added."""

    def total(d: Column) -> Column:
        def at(i: Column) -> Column:
            value = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(value > 4, 2 * value - 9).otherwise(2 * value)
            return F.when((F.length(d) - i) % 2 == 1, twice).otherwise(value)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + at(i))

    return let(digits, total) % 10 == 0


def small_parts(x: Column) -> Column:
    """Whether all four numbers of an address are at most 255, zeros before them aside."""
    return F.forall(F.split(x, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255"))))


def card_like(x: Column) -> Column:
    return let(digits_of(x), lambda d: F.when(F.length(d).between(13, 19), passes_luhn(d)).otherwise(F.lit(False)))


def phone_like(x: Column) -> Column:
    return F.length(digits_of(x)).between(9, 15)


PATTERNS = ((EMAIL, None), (IP, small_parts), (CARD, card_like), (PHONE, phone_like))


def base_spans(text: Column) -> Column:
    """Base spans as (kind, start, end), by kind, then start."""
    none = F.array().cast(_SPANS)
    # what any match holds; a text without it isn't searched
    there = (text.contains("@"), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"[0-9][\x20-]?[0-9]"), text.rlike(r"\+[0-9]"))
    found = []
    for kind, (pattern, fits) in enumerate(PATTERNS):
        spans = located(text, pattern, kind, (lambda f: lambda _, x: f(x))(fits) if fits else None)
        found.append(F.when(there[kind], F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(none))
    return F.concat(*found)


def kind_of(value: Column) -> Column:
    """The place in KINDS of the first base pattern that an identifier holds, or null."""
    out = F.lit(None).cast("int")
    for kind, (pattern, fits) in reversed(list(enumerate(PATTERNS))):
        first = F.regexp_extract(value, pattern, 0)
        ok = F.length(first) > 0
        out = F.when((ok & fits(first)) if fits else ok, F.lit(kind)).otherwise(out)
    return out


def identifiers(text: Column) -> Column:
    """Identifiers of a text: (start, end, value, left), left being the last two words before it, the later one first."""

    def of(found: Column) -> Column:
        gaps = F.split(text, STRETCH, -1)

        def placed(g: Column) -> Column:
            before = running_totals(F.transform(found, lambda x, k: F.length(F.get(g, k)) + F.length(x)))

            def one(b: Column) -> Column:
                def item(x: Column, k: Column) -> Column:
                    core = F.regexp_replace(x, LEADING, "")
                    value = F.regexp_replace(core, TRAILING, "")
                    start = F.get(b, k) + F.length(F.get(g, k)) + F.length(x) - F.length(core)
                    words = F.filter(F.split(F.lower(F.right(F.get(g, k), F.lit(REACH))), NOT_WORD), lambda w: w != "")
                    left = F.slice(F.reverse(words), 1, 2)
                    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), left.alias("left"))

                return F.transform(found, item)

            return let(before, one)

        return let(gaps, placed)

    everything = let(F.regexp_extract_all(text, F.lit(STRETCH), F.lit(0)), of)
    enough = lambda s: (F.length(s["value"]) >= MIN_LENGTH) & ((F.length(digits_of(s["value"])) >= MIN_DIGITS) | s["value"].contains("@"))
    return F.filter(everything, enough)


def patterns_of(left: Column) -> Column:
    """The lexical patterns that the words before an identifier make: the last word, and the last two."""
    one = F.concat(F.get(left, 0), F.lit(" #"))
    return F.filter(F.array(one, F.concat(F.get(left, 1), F.lit(" "), one)), lambda p: p.isNotNull())


def occurrences(docs: DataFrame) -> DataFrame:
    """Every identifier of the texts: digest of its text, start, end, value, kind (null if no base pattern is in it) and its patterns."""
    text = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    each = text.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.explode(identifiers(F.col("text"))).alias("i"))
    return keep(each.select("digest", "i.start", "i.end", "i.value", kind_of(F.col("i.value")).alias("kind"), patterns_of(F.col("i.left")).alias("patterns")), "identifiers")


def context_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, n: how often the words of a wanted pattern come in all texts."""

    def hashes(w: Column) -> Column:
        ones = F.transform(w, lambda x: F.xxhash64(F.concat(x, F.lit(" #"))))
        twos = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.xxhash64(F.concat(F.get(w, k - 1), F.lit(" "), F.get(w, k), F.lit(" #"))))
        return F.concat(ones, F.when(F.size(w) > 1, twos).otherwise(F.array().cast("array<bigint>")))

    # identifiers are no words
    text = F.when(F.col("text").rlike("[0-9@]"), F.regexp_replace("text", STRETCH, " ")).otherwise(F.col("text"))
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
    keys = wanted.select("pattern", F.xxhash64("pattern").alias("h"))
    every = docs.where("text IS NOT NULL").select(F.explode(let(words, hashes)).alias("h"))
    return every.join(keys.select("h"), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n")).join(keys, "h").select("pattern", "n")


def trusted(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, trust) and (value, kind, score) above the thresholds, from the graph of patterns and identifiers."""
    edges = found.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").alias("own")).groupBy("pattern", "value", "own").agg(F.count("*").alias("n"))
    edges = keep(edges, "edges")
    induced = keep(edges.where("own IS NOT NULL").groupBy("pattern", F.col("own").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS), "induced")
    near = edges.join(induced.select("pattern").distinct(), "pattern", "left_semi")
    followed = near.groupBy("pattern").agg(F.sum("n").alias("followed"), F.count("*").alias("values"))
    counts = context_counts(docs, induced.select("pattern").distinct())
    rate = F.least(F.lit(1.0), F.col("followed") / F.greatest("n", "followed"))
    about = keep(induced.join(followed, "pattern").join(counts, "pattern").select("pattern", "kind", "values", rate.alias("rate")), "patterns")
    # a pattern's score can't pass its precision, so others have no part in the rounds
    about = about.where(F.col("rate") >= MIN_TRUST)
    links = keep(near.join(about, "pattern").select("pattern", "kind", "value", "own", "values", "rate"), "links")
    scores = links.where("own IS NULL").select("value", "kind").distinct().withColumn("score", F.lit(0.0))
    for _ in range(ROUNDS):
        seed = F.when(F.col("own") == F.col("kind"), 1.0).when(F.col("own").isNotNull(), 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
        scored = links.join(scores, ["value", "kind"], "left").select("pattern", "kind", "values", "rate", seed.alias("score"))
        trust = scored.groupBy("pattern", "kind").agg((F.max("rate") * F.sum("score") / F.max("values")).alias("trust"))
        trust = keep(trust.where(F.col("trust") >= MIN_TRUST), "trust")
        missed = F.sum(F.log(1 - F.least(F.col("trust"), F.lit(1 - 1e-9))))
        scores = keep(links.where("own IS NULL").join(trust, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(missed)).alias("score")), "scores")
    return trust, scores.where(F.col("score") >= MIN_SCORE)


def learnt_spans(docs: DataFrame) -> DataFrame:
    """digest of a text and the spans (kind, start, end) that contexts find in it, base spans or not."""
    found = occurrences(docs)
    trust, scores = trusted(docs, found)
    places = found.where("kind IS NULL").select("digest", "start", "end", "value", F.explode("patterns").alias("pattern")).distinct()
    sure = places.join(trust, "pattern").join(scores, ["value", "kind"])
    best = sure.groupBy("digest", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    span = F.struct((F.col("kind") + len(KINDS)).alias("kind"), F.col("start").alias("start"), F.col("end").alias("end"))
    return best.groupBy("digest").agg(F.array_sort(F.collect_list(span)).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), kind a place in KINDS + NEAR."""
    text = F.coalesce("text", F.lit(""))
    # rows of one text, however many, are dealt to SALTS tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    base = docs.select("doc_id", base_spans(text).alias("base"), F.sha2(text.cast("binary"), 256).alias("digest"), salt.alias("salt"))
    learnt = learnt_spans(docs).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = base.join(learnt, ["digest", "salt"], "left")
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return both.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", apart)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every span of text masked; null texts stay null."""
    found = scan(docs.select(F.struct(*quoted(docs.columns)).alias("doc_id"), "text"))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    found = found.select("doc_id", masked(F.col("doc_id.text"), by_start, MASK).alias("new"))
    return found.select(*(F.col("new").alias("text") if c == "text" else F.col("doc_id")[c].alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS + NEAR))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", (lambda k: lambda s: s["kind"] == k)(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
