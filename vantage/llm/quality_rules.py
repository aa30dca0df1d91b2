"""Quality rules, line first: lines that fail a rule go, then documents that lost too much.

Base counts of a document: words, their code points, symbols, lines equal to an earlier
one, and words inside 8-word windows that occur twice or more. A document with fewer
than 20 words, or more than 30% of its words in such windows, fails at once.

Line rules, on lines with a word, go by form alone, whatever the language: a line of many
words must have the end of a sentence; a line is navigation if separators stand between
its words; it is boilerplate if COMMON_SHARE of all documents hold the very same line, or
it has braces or rights' signs, or most of it is capitals; it is noise if symbols or
doubled exclamation marks take too much of it; and it may not repeat an earlier line.
What is left is the cleaned text. A document that lost more than MAX_LOST of its word
characters is rejected.

How many documents hold a line is summed, by the line's hash, before the shuffle. At most
one in COMMON_SHARE of the lines that a mean document has can be so common, so they are
few, and they go along with the rules as one array. The rest is expressions on one row:
a document is never split or gathered.

Cases: null text counts as empty, has no words and fails; very long texts are worked
through in n log n; null or repeated doc_ids are rows of their own; ties don't occur, as
every rule is a threshold; an empty table gives no rows; other columns, whatever their
names, are ignored by rate() and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let
from .shared import documents, quoted

WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
MAX_LOST = 50
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line of so many blanks is long.
LONG_LINE = 5
#: The end of a sentence; it means the same to Java's regular expressions and to RE2.
SENTENCE = r"[.!?\x{2026}][)\]\"'\x{bb}\x{201d}]*([\x20\x09-\x0D]|$)"
BARS, ARROWS, FURNITURE = "|", ">\u00bb\u203a", "{}\u00a9\u00ae"
CAPITALS = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)))
SYMBOL_SHARE, CAPITAL_SHARE = 10, 50
#: A line is common if more than this share of all documents, in thousandths, and more than LEAST_COMMON of them, hold it.
COMMON_SHARE, LEAST_COMMON = 5, 20


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """How many words stand in a window that the text holds twice or more.

    Windows are told apart by a 64-bit hash of their words' hashes. Only a text with a
    repeated window is sorted.
    """
    # of two, of four, of eight words
    paired = lambda h, d: F.transform(F.sequence(F.lit(0), F.size(h) - d - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + d)))
    hashes = lambda h: let(paired(h, 1), lambda two: let(paired(two, 2), lambda four: paired(four, 4)))

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(by_hash, lambda s: let(starts(s), total))

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))

    return F.when(F.size(ws) >= WINDOW, let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(hashes(h), counted))).otherwise(F.lit(0))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def fails(line: Column, common: Column) -> Column:
    """Whether a line (with a word) breaks a rule on its own. common: hashes of the lines that many documents hold."""
    size = F.length(line)
    count = lambda characters: size - F.length(without(line, characters))
    return (
        ((count(BLANKS) >= LONG_LINE) & ~line.rlike(SENTENCE))
        | (count(BARS) >= 2)
        | (count(ARROWS) >= 3)
        | (count(FURNITURE) >= 1)
        | (count(CAPITALS) * 100 > size * CAPITAL_SHARE)
        | (count(SYMBOLS) * 100 > size * SYMBOL_SHARE)
        | ((size - F.length(F.replace(line, F.lit("!!"), F.lit("")))) * 100 > size * SYMBOL_SHARE)
        | F.array_contains(common, F.xxhash64(line))
    )


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), has_word)


def common_lines(docs: DataFrame) -> DataFrame:
    """One row: common, the hashes of lines that more than COMMON_SHARE thousandths of docs hold, each once a document."""
    held = docs.select(F.explode(F.array_distinct(F.transform(lines_of(text_of(F.col("text"))), lambda x: F.xxhash64(x)))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    often = held.where(F.col("n") > LEAST_COMMON).join(F.broadcast(total)).where(F.col("n") * 1000 > F.col("total") * COMMON_SHARE)
    return often.agg(F.collect_list("h").alias("common"))


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the method's counts, and cleaned, the text that is left. docs is read twice."""
    text = text_of(F.col("text"))
    measured = docs.select("doc_id", "text").join(F.broadcast(common_lines(docs.select("text")))).select(
        "doc_id",
        let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        # each line once, in the order in which they come; equal ones after the first are dropped
        let(lines_of(text), lambda all_: let(F.array_distinct(all_), lambda once: F.struct((F.size(all_) - F.size(once)).cast("long").alias("n_dup_lines"), F.filter(once, lambda x: ~fails(x, F.col("common"))).alias("left")))).alias("l"),
    )
    measured = measured.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", F.array_join("l.left", "\n").alias("cleaned"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    chars_left = F.length(without(F.col("cleaned"), BLANKS)).cast("long")
    kept = ~base_failed & (100 * (F.col("word_chars") - chars_left) <= MAX_LOST * F.col("word_chars"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"), chars_left.alias("chars_left"), "cleaned")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns, with their cleaned text."""
    kept = rate(docs.select(F.struct(*quoted(docs.columns)).alias("doc_id"), "text")).where("kept")
    return kept.select(*(F.col("doc_id")[c].alias(c) if c != "text" else F.col("cleaned").alias("text") for c in docs.columns))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(documents(spark, sf_dir)).drop("cleaned")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP5_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM worded WHERE len(ws) >= 8)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id
), often AS (
  SELECT line FROM (SELECT DISTINCT doc_id, unnest(ls) AS line FROM worded) GROUP BY line HAVING count(*) > {LEAST_COMMON} AND count(*) * 1000 > (SELECT count(*) FROM documents) * {COMMON_SHARE}
), numbered AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM worded
), judged AS (
  SELECT doc_id, line, k FROM numbered QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY k) = 1
), left_over AS (
  SELECT doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS n FROM judged
  WHERE NOT ((length(line) - length(translate(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) >= {LONG_LINE} AND NOT regexp_matches(line, {_quoted(SENTENCE)}))
    OR length(line) - length(replace(line, '|', '')) >= 2 OR length(line) - length(translate(line, '{ARROWS}', '')) >= 3 OR length(line) - length(translate(line, '{FURNITURE}', '')) >= 1
    OR (length(line) - length(translate(line, '{CAPITALS}', ''))) * 100 > length(line) * {CAPITAL_SHARE}
    OR (length(line) - length(translate(line, '{SYMBOLS}', ''))) * 100 > length(line) * {SYMBOL_SHARE}
    OR (length(line) - length(replace(line, '!!', ''))) * 100 > length(line) * {SYMBOL_SHARE}
    OR line IN (SELECT line FROM often))
  GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(l.n, 0) AS BIGINT) AS chars_left
  FROM worded w LEFT JOIN covered c USING (doc_id) LEFT JOIN left_over l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * (word_chars - chars_left) <= {MAX_LOST} * word_chars AS kept,
  chars_left
FROM counted
"""
