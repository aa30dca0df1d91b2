"""Preference formatting: two conversations, their longest common turn prefix, paired masked completions.

A pair has a chosen and a rejected conversation. The turns that both begin with are
rendered once, as the prompt; what follows in each becomes its completion, with a mask:
the code-point spans of assistant turns, which alone are trained on.

A row holds a pair's turns of one stretch of CHUNK turn numbers, so it is the whole pair
unless a conversation is longer than that; then its rows, in order of chunk, follow on
one another, and no conversation is one row or one task, however long. Texts go through
one shuffle, by pair and chunk. Whether an earlier chunk has ended the prompt is told
from hashes that are summed before their own shuffle.

Cases: turns are ordered by (turn, role, text), nulls first, and repeated rows stay
repeated; null role and text are rendered as empty and equal only null; null turns are
the first chunk, number null; a pair with one side only has an empty prompt and its other
completion is empty; rows without a conv_id belong to no pair; a very long text is one
turn like others; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import let, running_totals

TRAINED_ROLE = "assistant"
CHUNK = 256
SIDES = ("chosen", "rejected")


def render(role: Column, text: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def sided(turns: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """pair_id, is_chosen, chunk, turn, role, text."""
    turns = turns.select("conv_id", "turn", "role", "text")
    if pairs is None:
        out = turns.where("conv_id IS NOT NULL").select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turn", "role", "text")
    else:
        out = turns.join(pairs.select("pair_id", "conv_id", (F.col("side") == "chosen").alias("is_chosen")), "conv_id").drop("conv_id")
    return out.withColumn("chunk", F.floor(F.col("turn") / CHUNK))


def ended(rows: DataFrame) -> DataFrame:
    """pair_id, chunk, after: whether the sides differ in an earlier chunk."""
    sign = F.when(F.col("is_chosen"), 1).otherwise(-1)
    # two halves of a hash apart, each far from the limits of a sum
    h = F.xxhash64("turn", F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0")), F.col("role").isNull(), F.col("text").isNull(), F.col("turn").isNull())
    sums = rows.groupBy("pair_id", "chunk").agg(F.sum(sign * F.shiftright(h, 32)).alias("a"), F.sum(sign * h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"), F.sum(sign).alias("n"))
    before = W.partitionBy("pair_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return sums.select("pair_id", "chunk", F.coalesce(F.max((F.col("a") != 0) | (F.col("b") != 0) | (F.col("n") != 0)).over(before), F.lit(False)).alias("after"))


def preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row a pair and chunk: pair_id, chunk, n_prompt, prompt, and of each side its number of turns, text and spans to train on.

    turns: conv_id, turn, role, text. pairs: pair_id, conv_id, side ('chosen' or
    'rejected'); by default conversations 2k and 2k+1 are the two sides of pair k.
    """
    rows = sided(turns, pairs)
    turn = F.struct("turn", "role", "text")
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("is_chosen") == side, turn)), in_order)
    whole = rows.groupBy("pair_id", "chunk").agg(of(True).alias("x"), of(False).alias("y"))
    both = whole.alias("d").join(ended(rows).alias("e"), F.expr("d.pair_id = e.pair_id AND d.chunk <=> e.chunk")).select("d.*", "e.after")
    differ = F.filter(F.sequence(F.lit(0), F.least(F.size("x"), F.size("y"))), lambda i: ~F.get("x", i).eqNullSafe(F.get("y", i)))
    both = both.withColumn("n_prompt", F.when(F.col("after"), 0).otherwise(F.coalesce(F.get(differ, 0), F.size("x"))))
    text = lambda part: F.array_join(F.transform(part, lambda t: render(t["role"], t["text"])), "")
    rest = lambda side: F.slice(side, F.col("n_prompt") + 1, F.size(side))
    return both.select(
        "pair_id", "chunk", F.col("n_prompt").cast("long").alias("n_prompt"), text(F.slice("x", 1, F.col("n_prompt"))).alias("prompt"),
        *(c for name, side in zip(SIDES, ("x", "y")) for c in (F.size(rest(side)).cast("long").alias(f"n_{name}"), text(rest(side)).alias(name), trained(rest(side)).alias(f"{name}_spans"))),
    )


def in_order(a: Column, b: Column) -> Column:
    """Compares turns by (turn, role, text), nulls first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), -1).otherwise(1)
    return out


def trained(part: Column) -> Column:
    """Spans [start, end) of the turns to train on, in the text that part is rendered as."""
    lengths = F.transform(part, lambda t: F.length(render(t["role"], t["text"])))

    def placed(n: Column) -> Column:
        every = let(running_totals(n), lambda at: F.transform(part, lambda t, k: F.struct(F.get(at, k).alias("start"), (F.get(at, k) + F.get(n, k)).alias("end"), F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)).alias("own"))))
        return F.transform(F.filter(every, lambda s: s["own"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(lengths, placed)


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, 2k against 2k+1; spans as start:end, joined by commas."""
    out = preferences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({f"{side}_spans": listed(F.col(f"{side}_spans")) for side in SIDES})


OP10_SQL = f"""
WITH sided AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, (conv_id % 2 = 0) AS is_chosen, turn, role, text, CAST(floor(turn / {CHUNK}.0) AS BIGINT) AS chunk,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS segment
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, is_chosen ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM sided
), matched AS (
  SELECT a.pair_id, a.k FROM numbered a JOIN numbered b
    ON a.pair_id = b.pair_id AND a.k = b.k AND a.is_chosen AND NOT b.is_chosen
   AND a.turn IS NOT DISTINCT FROM b.turn AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text
), ranked AS (
  SELECT pair_id, k, row_number() OVER (PARTITION BY pair_id ORDER BY k) AS r FROM matched
), prefix AS (
  SELECT pair_id, count(*) AS len FROM ranked WHERE k = r GROUP BY pair_id
), parted AS (
  SELECT n.*, k <= coalesce(len, 0) AS shared FROM numbered n LEFT JOIN prefix USING (pair_id)
), placed AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY pair_id, is_chosen, chunk, shared ORDER BY k) AS upto FROM parted
)
SELECT pair_id, chunk,
  count(*) FILTER (WHERE shared AND is_chosen) AS n_prompt,
  coalesce(string_agg(segment, '' ORDER BY k) FILTER (WHERE shared AND is_chosen), '') AS prompt,
  count(*) FILTER (WHERE NOT shared AND is_chosen) AS n_chosen,
  coalesce(string_agg(segment, '' ORDER BY k) FILTER (WHERE NOT shared AND is_chosen), '') AS chosen,
  coalesce(string_agg(CAST(upto - length(segment) AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY k) FILTER (WHERE NOT shared AND is_chosen AND role = '{TRAINED_ROLE}'), '') AS chosen_spans,
  count(*) FILTER (WHERE NOT shared AND NOT is_chosen) AS n_rejected,
  coalesce(string_agg(segment, '' ORDER BY k) FILTER (WHERE NOT shared AND NOT is_chosen), '') AS rejected,
  coalesce(string_agg(CAST(upto - length(segment) AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY k) FILTER (WHERE NOT shared AND NOT is_chosen AND role = '{TRAINED_ROLE}'), '') AS rejected_spans
FROM placed GROUP BY pair_id, chunk
"""
