"""Agreement of masks, pivots of effects, tallies, and merges of registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(rows: DataFrame, key: list[str], a: Column, b: Column, valid: Column) -> DataFrame:
    """Counts of both, a only, b only and neither over valid rows, agreement in % and Jaccard index (1 where nothing is marked)."""
    x, y = valid & a, valid & b
    n = F.count_if(valid)
    both, either = F.count_if(x & y), F.count_if(x | y)
    return rows.groupBy(*key).agg(
        both.alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(y & ~x).alias("b_only"), F.count_if(valid & ~a & ~b).alias("neither"),
        F.coalesce(F.try_divide((both + F.count_if(valid & ~a & ~b)) * F.lit(100.0), n), F.lit(0.0)).alias("agreement_pct"),
        F.coalesce(F.try_divide(both * F.lit(1.0), either), F.lit(1.0)).alias("iou"),
    )


def effects(rows: DataFrame, key: list[str], variant: str, value: str, names: list[str]) -> DataFrame:
    """Means by variant side by side, and the step from each variant to the next."""
    wide = rows.groupBy(*key).pivot(variant, names).agg(F.avg(value))
    for before, after in zip(names, names[1:]):
        wide = wide.withColumn(f"{before}_to_{after}", F.col(after) - F.col(before))
    return wide


def tally(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Values by frequency, ties by first occurrence, with their share."""
    total = F.sum("n").over(W.partitionBy())
    counted = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.withColumns({"share": F.format_string("%.1f%%", F.lit(100.0) * F.col("n") / total), "rank": F.row_number().over(W.orderBy(F.desc("n"), "first"))}).drop("first")


def undocumented(rows: DataFrame, columns: list[str], vocabulary: DataFrame) -> DataFrame:
    """Tokens of any of the columns that the vocabulary (token) doesn't have."""
    tokens = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("token")) for c in columns))).alias("t")).select("t.*").where("token IS NOT NULL").distinct()
    return tokens.join(vocabulary.select("token"), "token", "left_anti")


def insert_only(registry: DataFrame, incoming: DataFrame, key: list[str], order: list) -> DataFrame:
    """The registry, untouched, and of the incoming rows the first of each key that it doesn't have."""
    fresh = incoming.join(registry.select(*key), key, "left_anti").withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
    return registry.unionByName(fresh)


def conflicts(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that both have with different values."""
    return a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key).where(~F.col("a").eqNullSafe(F.col("b")))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, status) of what is missing, added or moved between two manifests (name, digest)."""
    joined = old.select("name", F.col("digest").alias("a")).join(new.select("name", F.col("digest").alias("b")), "name", "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "moved")
    return joined.select("name", status.alias("status")).where("status IS NOT NULL")


def next_numbers(fresh: DataFrame, registry: DataFrame, entity: str, number: str, order: list) -> DataFrame:
    """fresh with numbers that go on from each entity's highest in the registry."""
    top = registry.groupBy(entity).agg(F.max(number).alias("_top"))
    place = F.row_number().over(W.partitionBy(entity).orderBy(*order))
    return fresh.join(top, entity, "left").withColumn(number, F.coalesce("_top", F.lit(0)) + place).drop("_top")


def thickness_ladder(rows: DataFrame, measured: str, by_type: str, default: float) -> DataFrame:
    """rows with thickness and its source: measured, else its type's median, else the default."""
    medians = rows.where(F.col(measured) > 0).groupBy(by_type).agg(F.median(measured).alias("_median"))
    out = rows.join(medians, by_type, "left")
    ok = F.col(measured) > 0
    return out.withColumns({"thickness": F.when(ok, F.col(measured)).otherwise(F.coalesce("_median", F.lit(default))), "source": F.when(ok, "measured").when(F.col("_median").isNotNull(), "type_median").otherwise("default")}).drop("_median")


def opening_rectangle(kinds: DataFrame, openings: DataFrame) -> DataFrame:
    """openings with their rectangle on the wall: blanks by kind, the place held inside the wall, the head below the roof.

    kinds: kind, d_width, d_sill, d_head, through. openings: kind, s, width, sill, head, length, ground, roof.
    On a wall too short for it, an opening is put by the lower limit first, then the upper.
    """
    o = openings.join(kinds, "kind")
    o = o.withColumns({"width": F.coalesce("width", "d_width"), "sill": F.coalesce("sill", "d_sill"), "head": F.coalesce("head", "d_head")})
    half = F.col("width") / 2 + 0.05
    s = F.least(F.greatest(F.col("s"), half), F.col("length") - half)
    return o.withColumn("s", s).withColumns({"s0": F.col("s") - F.col("width") / 2, "s1": F.col("s") + F.col("width") / 2, "z0": F.col("ground") + F.col("sill"), "z1": F.least(F.col("ground") + F.col("head"), F.col("roof") - 0.1)})
