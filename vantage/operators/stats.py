"""Goodness of fit, mixtures, permutation nulls, sequential stopping, robust fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def g_statistic(observed: DataFrame, classes: int) -> DataFrame:
    """G of counts (n) against equal shares of so many classes; empty classes add nothing."""
    total = F.sum("n").over(W.partitionBy())
    return observed.withColumn("_e", total / float(classes)).agg(F.sum(F.when(F.col("n") > 0, 2 * F.col("n") * F.log(F.col("n") / F.col("_e")))).alias("g"), F.sum("n").alias("n"))


def chi2_survival(x: Column, df: int, terms: int = 80) -> Column:
    """P(chi-square with df degrees > x): one less the lower series up to the bulk, the upper continued fraction beyond it."""
    a = df / 2
    h = F.greatest(x.cast("double"), F.lit(0.0)) / 2
    power = F.exp(a * F.log(F.when(h > 0, h)) - h - math.lgamma(a))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1 / a).alias("t"), F.lit(1 / a).alias("s")), lambda s, n: F.struct((s["t"] * h / (a + n)).alias("t"), (s["s"] + s["t"] * h / (a + n)).alias("s")), lambda s: s["s"])
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), h + (2 * terms + 1 - a), lambda c, n: h + 2 * (n - 1) + 1 - a - n * (n - a) / c)
    return F.when(h <= 0, 1.0).when(h < a + 1, 1 - power * series).otherwise(power / fraction)


def mixture_fit(observed: DataFrame, steps: int) -> DataFrame:
    """The weight w of shares p1 against p0 in observed (n, p1, p0) with the highest likelihood, over a grid; the first of equals."""
    spark = observed.sparkSession
    grid = spark.range(steps + 1).select((F.col("id") / float(steps)).alias("w"), "id")
    mixed = F.col("w") * F.col("p1") + (1 - F.col("w")) * F.col("p0")
    by_w = grid.join(observed.select("n", "p1", "p0")).groupBy("id", "w").agg(F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(mixed)).otherwise(0.0)).alias("ll"))
    return by_w.orderBy(F.desc(F.round("ll", 6)), "id").limit(1)


def mix_hash(*parts: Column) -> Column:
    """A 31-bit hash of whole numbers, the same in any engine: a sum by powers of one factor, then squared twice, as without that the hashes of neighbours would be in their own order."""
    prime = 2147483647
    out = F.lit(17).cast("bigint")
    for p in parts:
        out = (out * 48271 + p.cast("bigint") % prime + 11) % prime
    out = (out * out + 7) % prime * 16807 % prime
    return (out * out + 7) % prime


def permuted(rows: DataFrame, key: str, label: str, draws: int, seed: int | None = None) -> DataFrame:
    """draw, key, own, other: for each draw every row's own label and the one that a permutation gives it.

    Rows are paired by place: their order by key, and by a hash of (seed,) draw and key.
    """
    from .ledger import numbered

    drawn = rows.select(F.col(key).alias("_key"), F.col(label).alias("_label")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("draw", F.col("draw").cast("long"))
    parts = [] if seed is None else [F.lit(seed)]
    own = numbered(rows.select(F.col(key).alias("_key"), F.col(label).alias("own")).withColumn("_all", F.lit(0)), ["_all"], ["_key"], "k").drop("_all")
    other = numbered(drawn.withColumn("_h", mix_hash(*parts, F.col("draw"), F.col("_key"))), ["draw"], ["_h", "_key"], "k").select("draw", "k", F.col("_label").alias("other"))
    return other.join(own, "k").select("draw", F.col("_key").alias(key), "own", "other")


def permuted_matches(rows: DataFrame, key: str, label: str, draws: int) -> DataFrame:
    """For each draw, how many rows meet their own label under a permutation of labels."""
    return permuted(rows, key, label, draws).groupBy("draw").agg(F.count_if(F.col("own") == F.col("other")).alias("v"))


def empirical_p(draws: DataFrame, observed: Column) -> DataFrame:
    """One row: n, how many draws reach the observed value, p with the observed draw counted, median, quartiles and effect."""
    a = draws.agg(F.count("*").alias("n"), F.count_if(F.col("v") >= observed).alias("n_ge"), F.percentile("v", 0.5).alias("median"), F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.75).alias("q3"))
    return a.withColumns({"p": (F.col("n_ge") + 1) / (F.col("n") + 1), "effect": F.try_divide(observed - F.col("median"), F.col("q3") - F.col("q1"))})


def sequential_stop(draws: DataFrame, key: list[str], order: str, observed: str, hits: int) -> DataFrame:
    """Per key the draw at which the hits-th value reaches the observed one, and p: hits / that draw, or (1 + reached) / (1 + n)."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ge = F.when(F.col("v") >= F.col(observed), 1).otherwise(0)
    run = draws.withColumns({"_k": F.row_number().over(W.partitionBy(*key).orderBy(order)), "_cum": F.sum(ge).over(w)})
    out = run.groupBy(*key).agg(F.min(F.when(F.col("_cum") >= hits, F.col("_k"))).alias("stopped_at"), F.max("_cum").alias("reached"), F.count("*").alias("n"))
    return out.withColumn("p", F.when(F.col("stopped_at").isNotNull(), F.lit(float(hits)) / F.col("stopped_at")).otherwise((F.col("reached") + 1.0) / (F.col("n") + 1.0)))


def fit_line_mad(points: DataFrame, rounds: int = 5, floor: float = 1.0) -> tuple[float, float, int]:
    """Slope, intercept and rows kept of a least-squares line over (x, y), refitted without rows farther off than median + 3 robust deviations. Only sums and medians reach the driver."""
    kept, cutoff, count = points, None, None
    for _ in range(rounds):
        m = kept.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx")).first()
        if not m["n"]:
            return 0.0, 0.0, 0
        slope = m["cxy"] / m["vx"] if m["vx"] else 0.0
        icept = m["my"] - slope * m["mx"]
        off = F.abs(F.col("y") - (slope * F.col("x") + icept))
        if m["n"] == count:
            break
        count = m["n"]
        med = points.agg(F.median(off)).first()[0]
        mad = points.agg(F.median(F.abs(off - med))).first()[0]
        cutoff = max(med + 3 * 1.4826 * mad, floor)
        kept = points.where(off <= cutoff)
    return slope, icept, m["n"]
