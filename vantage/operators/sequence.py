"""Ordered data: islands, gaps, headings, carry-over, first statements, rising runs, Holm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_intervals(spans: DataFrame, key: list[str], eps: float = 0.0) -> DataFrame:
    """Spans (key, lo, hi) merged where they overlap or lie within eps of each other."""
    order = W.partitionBy(*key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.where("lo <= hi").withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach + eps), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


def ring_gaps(merged: DataFrame, key: list[str], length: Column, low: float, high: float) -> DataFrame:
    """Gaps between merged spans (key, lo, hi) round a ring of a length, the one over its end included, with low <= width <= high."""
    order = W.partitionBy(*key).orderBy("lo")
    whole = W.partitionBy(*key)
    nxt = F.coalesce(F.lead("lo").over(order), F.min("lo").over(whole) + length)
    gaps = merged.withColumn("start", F.col("hi")).withColumn("width", nxt - F.col("hi"))
    return gaps.where((F.col("width") >= low) & (F.col("width") <= high)).select(*key, (F.pmod(F.col("start") + F.col("width") / 2, length)).alias("mid"), "width")


def carry_headings(lines: DataFrame, doc: list[str], order: list[str], heading: Column, within: list[str] | None = None) -> DataFrame:
    """lines with heading_id, the last heading at or before each. within: the columns at which carrying stops (by default doc)."""
    w = W.partitionBy(*(within or doc)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("heading_id", F.last(heading, ignorenulls=True).over(w))


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def prefer_placed(rows: DataFrame, entity: list[str], place: str, order: list) -> DataFrame:
    """Rows with a place, one a place; and of entities without any, one row without."""
    placed = first_by(rows.where(F.col(place).isNotNull()), [*entity, place], order)
    loose = first_by(rows.where(F.col(place).isNull()), entity, order).join(placed.select(*entity).distinct(), entity, "left_anti")
    return placed.unionByName(loose)


def longest_rising(values: Column) -> Column:
    """Length of the longest strictly rising subsequence of an array, by patience piles kept in an array."""
    empty = F.array().cast("array<bigint>")

    def put(piles: Column, x: Column) -> Column:
        k = F.size(F.filter(piles, lambda p: p < x))
        return F.concat(F.slice(piles, 1, k), F.array(x.cast("bigint")), F.slice(piles, k + 2, F.greatest(F.size(piles) - k - 1, F.lit(0))))

    return F.size(F.aggregate(values, empty, put))


def rising_rows(values: Column) -> Column:
    """Places, from 0, of a longest strictly rising subsequence of an array: back from the last value that ends one, always by the latest that can stand before it."""
    start = F.struct(F.array().cast("array<bigint>").alias("piles"), F.array().cast("array<int>").alias("pile"))

    def put(acc: Column, x: Column) -> Column:
        k = F.size(F.filter(acc["piles"], lambda p: p < x))
        piles = F.concat(F.slice(acc["piles"], 1, k), F.array(x.cast("bigint")), F.slice(acc["piles"], k + 2, F.greatest(F.size(acc["piles"]) - k - 1, F.lit(0))))
        return F.struct(piles.alias("piles"), F.concat(acc["pile"], F.array(k)).alias("pile"))

    pile_of = F.aggregate(values, start, put, lambda acc: acc["pile"])

    def back(acc: Column, p: Column) -> Column:
        hit = p["pile"] == acc["want"]
        return F.struct((acc["want"] - hit.cast("int")).alias("want"), F.when(hit, F.concat(F.array(p["k"]), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

    placed = F.reverse(F.transform(pile_of, lambda p, k: F.struct(p.alias("pile"), k.alias("k"))))
    first = F.struct(F.coalesce(F.array_max(pile_of), F.lit(-1)).alias("want"), F.array().cast("array<int>").alias("kept"))
    return F.aggregate(placed, first, back, lambda acc: acc["kept"])


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """tests with p_holm and reject; equal p by name."""
    order = W.orderBy(p, name)
    ranked = tests.withColumns({"_i": F.row_number().over(order) - 1, "_m": F.count("*").over(W.partitionBy())})
    raised = F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p))
    return ranked.withColumn("p_holm", F.max(raised).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("reject", F.col("p_holm") <= alpha).drop("_i", "_m")


def cumulative_starts(rows: DataFrame, key: list[str], order: str, length: str) -> DataFrame:
    """rows with start, the sum of the lengths before."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))


def ring_edges(vertices: DataFrame, key: list[str], order: str) -> DataFrame:
    """Consecutive vertices (x, y) of each ring, the last with the first."""
    w = W.partitionBy(*key).orderBy(order)
    first = lambda c: F.first(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return vertices.select(*key, F.col(order).alias("edge"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce(F.lead("x").over(w), first("x")).alias("x1"), F.coalesce(F.lead("y").over(w), first("y")).alias("y1"))
