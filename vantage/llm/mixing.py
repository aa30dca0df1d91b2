"""Mixing sources to target weights by Pareto order sampling.

Sizes are word counts. Sources, sorted by code point with null last, weigh 5, 2, 1,
repeating; together they share the size of all documents. A target stops at CAP times
its source's size, and what is above goes to the other sources by weight until none is
above.

Within a source documents are not taken alike: one of a size class (SIZE_WEIGHTS) is to
be taken min(CAP, level * weight) times, with the level that makes the source's expected
words its target. The whole part are certain copies, and the rest is the inclusion
probability p of one more copy. That copy is drawn by Pareto order sampling: documents
are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken
from the front until the words asked for are there, so that the size of the sample is
fixed and not random. The document at the end of it is taken if that comes nearer to the
target. u is a hash of doc_id, so reruns agree.

A cumulative sum over a source that holds a third of all rows would be one task's work.
Instead the rank is cut into BINS x BINS bins; sums by source and bin, made before the
shuffle, lead to the one bin in which a source's cut lies, and only that bin is sorted.

Cases: null text has size 0; null doc_id is hashed as the empty text; rows that repeat a
doc_id within a source are taken or left together; an empty table, or one without
words, gives targets 0; other columns, whatever their names, are kept by mix(). Sources
are ranked in one task and should be few (some million at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, keep, quoted, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 4096
#: Weight of documents with fewer than so many words; the last is of all others.
SIZE_WEIGHTS = ((40, 1), (150, 2), (1500, 4), (None, 3))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target. sized: source, size.

    Sources are filled in the order of cap over weight. One is held at its cap when an
    equal level for it and all later ones would pass the cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    per = per.withColumn("w", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * CAP)
    by_fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto, everything = by_fill.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    per = per.withColumns({
        "left": F.sum("source_size").over(everything) - F.sum("cap").over(upto) + F.col("cap"),
        "w_left": F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w"),
    })
    per = per.withColumn("level", F.col("left") / F.col("w_left"))
    per = per.withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.min_by("level", F.when(~F.col("capped"), -F.col("w_left"))).over(everything)
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def uniform52(doc_id):
    """A 52-bit integer from the id's hash; (it + 0.5) / 2^52 is uniform."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def size_weight(size):
    """The weight of a document's size class."""
    out = F.lit(SIZE_WEIGHTS[-1][1])
    for below, weight in SIZE_WEIGHTS[-2::-1]:
        out = F.when(size < below, weight).otherwise(out)
    return out


def class_rates(sized: DataFrame, per: DataFrame) -> DataFrame:
    """source, weight, certain, p and rest (the source's words that p has to bring): one row a source and size class. per: source, source_size, target.

    The heaviest classes are held at CAP first, while an equal level for them and all lighter ones would pass it.
    """
    words = sized.groupBy("source", size_weight(F.col("size")).alias("weight")).agg(F.sum("size").alias("words"))
    words = words.alias("d").join(per.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.target")
    heavier = W.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    weighed = F.col("weight") * F.col("words")
    left = F.col("target") - CAP * F.coalesce(F.sum("words").over(heavier), F.lit(0))
    light = F.sum(weighed).over(whole) - F.coalesce(F.sum(weighed).over(heavier), F.lit(0))
    words = words.withColumn("level", F.when(light > 0, left / light).otherwise(0.0))
    words = words.withColumn("capped", F.col("level") * F.col("weight") >= CAP)
    level = F.max_by("level", F.when(~F.col("capped"), F.col("weight"))).over(whole)
    words = words.withColumn("rate", F.when(F.col("capped"), F.lit(float(CAP))).otherwise(level * F.col("weight")))
    words = words.withColumn("certain", F.floor("rate"))
    words = words.withColumns({"p": F.col("rate") - F.col("certain"), "rest": F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole)})
    return words.select("source", "weight", "certain", "p", "rest")


def ranked(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, ...) with the numbers of their class and their place in their source's order. rates is small, and Spark sees its size."""
    out = rows.alias("d").join(rates.alias("s"), F.expr("d.source <=> s.source") & (size_weight(F.col("d.size")) == F.col("s.weight"))).select("d.*", "s.certain", "s.rest", "s.p")
    r = uniform52(F.col("doc_id"))
    u = (r + 0.5) / F.lit(float(2**52))
    odds = F.col("p") / (1 - F.col("p"))
    out = out.withColumns({"r": r, "rank": F.when(F.col("p") > 0, (u / (1 - u)) / odds)})
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * (BINS * BINS))
    return out.withColumn("bin", F.least(place, F.lit(BINS * BINS - 1)))


def sampling(sized: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per, rates, ends): each source's target, its classes' rates, and where its sample ends. sized: doc_id, source, size, read more than once."""
    per = keep(source_targets(sized), "mix-sources")
    rates = keep(class_rates(sized, per), "mix-rates")
    drawn = ranked(sized, rates).where("rank IS NOT NULL").withColumn("bin1", F.floor(F.col("bin") / BINS))

    def cut(sums: DataFrame, key: str, start: str | None) -> DataFrame:
        """Of each source the first bin with which the words reach rest, and the words before it."""
        order = W.partitionBy("source").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(order) + (F.col(start) if start else F.lit(0)))
        return sums.where("upto >= rest").groupBy("source").agg(F.min(F.struct(key, (F.col("upto") - F.col("words")).alias("before"))).alias("c")).select("source", F.col(f"c.{key}").alias(key), F.col("c.before").alias("before"))

    cut1 = keep(cut(drawn.groupBy("source", "bin1", "rest").agg(F.sum("size").alias("words")), "bin1", None), "mix-cut1")
    inside = drawn.alias("d").join(cut1.alias("c"), F.expr("d.source <=> c.source AND d.bin1 = c.bin1")).select("d.*", "c.before")
    cut2 = keep(cut(inside.groupBy("source", "bin", "rest", "before").agg(F.sum("size").alias("words")), "bin", "before"), "mix-cut2")
    last = drawn.alias("d").join(cut2.alias("c"), F.expr("d.source <=> c.source AND d.bin = c.bin")).select("d.*", "c.before")
    last = last.groupBy("source", "bin", "rest", "before", "rank", "r", "doc_id").agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy("rank", "r", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("words").over(order) + F.col("before"))
    short = F.col("rest") - (F.col("upto") - F.col("words"))
    taken = (F.col("upto") <= F.col("rest")) | ((short > 0) & (F.col("upto") - F.col("rest") < short))
    ends = last.groupBy("source", "bin").agg(F.max(F.when(taken, F.struct("rank", "r", "doc_id"))).alias("end"))
    return per, rates, keep(ends, "mix-ends")


def with_copies(rows: DataFrame, rates: DataFrame, ends: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, ...) with copies. It depends on the row and its source alone, so nothing large is joined."""
    names = rows.columns
    out = ranked(rows, rates).alias("d").join(ends.select("source", F.col("bin").alias("end_bin"), "end").alias("e"), F.expr("d.source <=> e.source"), "left")
    own = F.struct(F.col("rank"), F.col("r"), F.col("d.doc_id"))
    first = (F.col("bin") < F.col("end_bin")) | ((F.col("bin") == F.col("end_bin")) & F.coalesce(own <= F.col("end"), F.lit(False)))
    more = F.when(F.col("rank").isNull(), False).when(F.col("end_bin").isNull(), F.col("rest") > 0).otherwise(first)
    return out.select(*(F.col(f"d.{c}") for c in names), (F.col("certain") + more.cast("long")).alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, written down: the texts are read once."""
    return keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs, all its columns, as often as it is taken."""
    _, rates, ends = sampling(sizes(docs))
    whole = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*quoted(docs.columns)).alias("row"))
    taken = with_copies(whole, rates, ends).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sizes(documents(spark, sf_dir))
    per, rates, ends = sampling(sized)
    out = with_copies(sized, rates, ends).alias("d").join(per.alias("s"), F.expr("d.source <=> s.source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per
), filled AS (
  SELECT *, (sum(source_size) OVER () - sum(cap) OVER o + cap)::DOUBLE / (sum(w) OVER () - sum(w) OVER o + w)::DOUBLE AS level, sum(w) OVER () - sum(w) OVER o + w AS w_left
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), aimed AS (
  SELECT source, source_size, CASE WHEN level * w >= cap THEN cap::DOUBLE
    ELSE (SELECT arg_max(level, w_left) FROM filled WHERE level * w < cap) * w END AS target FROM filled
), classed AS (
  SELECT *, CASE WHEN size < 40 THEN 1 WHEN size < 150 THEN 2 WHEN size < 1500 THEN 4 ELSE 3 END AS weight FROM sized
), class_words AS (
  SELECT c.source, weight, a.source_size, a.target, CAST(sum(size) AS BIGINT) AS words
  FROM classed c JOIN aimed a ON c.source IS NOT DISTINCT FROM a.source GROUP BY ALL
), levelled AS (
  SELECT *, coalesce(CAST(sum(words) OVER h AS BIGINT), 0) AS words_above, coalesce(CAST(sum(weight * words) OVER h AS BIGINT), 0) AS weighed_above,
    CAST(sum(weight * words) OVER (PARTITION BY source) AS BIGINT) AS weighed
  FROM class_words WINDOW h AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stepped AS (
  SELECT *, CASE WHEN weighed > weighed_above THEN (target - 3 * words_above) / CAST(weighed - weighed_above AS DOUBLE) ELSE 0 END AS level FROM levelled
), rated AS (
  SELECT *, CASE WHEN level * weight >= 3 THEN 3.0::DOUBLE
    ELSE arg_max(level, weight) FILTER (WHERE level * weight < 3) OVER (PARTITION BY source) * weight END AS rate FROM stepped
), asked AS (
  SELECT source, source_size, target, weight, CAST(floor(rate) AS BIGINT) AS certain, rate - floor(rate) AS p,
    target - CAST(sum(CAST(floor(rate) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM rated
), ranked AS (
  SELECT s.doc_id, s.source, s.size, a.source_size, a.target, a.certain, a.rest, a.p,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS r
  FROM classed s JOIN asked a ON s.source IS NOT DISTINCT FROM a.source AND s.weight = a.weight
), odds AS (
  SELECT *, (r + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, CASE WHEN p > 0 THEN p / (1 - p) END AS o FROM ranked
), summed AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / o NULLS LAST, r, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM odds
)
SELECT doc_id, size, source_size, target,
  CAST((certain + CASE WHEN p > 0 AND rest > 0 AND (upto <= rest OR (rest - (upto - size) > 0 AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM summed
"""
