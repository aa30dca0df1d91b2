"""Tables about findings: rounded and ranked measures, roll-ups, duplicates, clusters, runs, checks, fingerprints."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import kept
from .stats import mix_hash


def rounded(df: DataFrame, places: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """All floating columns but some, rounded half to even."""
    return df.select(*(F.bround(F.col(f"`{n}`"), places).alias(n) if t in ("double", "float") and n not in skip else F.col(f"`{n}`") for n, t in df.dtypes))


def best_by_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """The key with the highest mean, the first of equals."""
    return df.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), key).limit(1)


def whole_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids that read as numbers, cut to whole ones; others go."""
    return df.select(F.col(column).cast("string").try_cast("double").cast("long").alias("id")).where("id IS NOT NULL").distinct()


def with_fallback(rows: DataFrame, value: str, size: str, least: float, share: float) -> DataFrame:
    """rows with measured, or where value is missing the median ratio of value to size times its size, no less than least and no more than share of the size."""
    ratio = rows.where(F.col(value).isNotNull() & (F.col(size) > 0)).agg(F.median(F.col(value) / F.col(size)).alias("_ratio"))
    out = rows.join(F.broadcast(ratio))
    guess = F.least(F.greatest(F.lit(least), F.coalesce("_ratio", F.lit(0.0)) * F.col(size)), share * F.col(size))
    return out.withColumns({"measured": F.col(value).isNotNull(), value: F.coalesce(F.col(value), guess)}).drop("_ratio")


def rollup(targets: DataFrame, sightings: DataFrame, target: str, owner: str, observer: str, distance: str, most: int = 8) -> DataFrame:
    """Per target: whether its own owner sees it, how many others do, the nearest of them, and the first so many of their ids.

    targets: target, owner; sightings: target, observer, distance. Only the smallest ids
    are gathered, from sums made before the shuffle.
    """
    seen = sightings.groupBy(target, observer).agg(F.min(distance).alias("_d")).join(targets, target)
    other = F.col(observer) != F.col(owner)
    ranked = seen.withColumn("_k", F.row_number().over(W.partitionBy(target, other).orderBy(observer)))
    s = ranked.groupBy(target).agg(
        F.bool_or(~other).alias("own"), F.count_if(other).alias("n_others"), F.min(F.when(other, F.col("_d"))).alias("nearest"),
        F.array_join(F.array_sort(F.collect_list(F.when(other & (F.col("_k") <= most), F.col(observer)))).cast("array<string>"), "|").alias("others"),
    )
    out = targets.join(s, target, "left")
    return out.select(*targets.columns, F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("n_others", F.lit(0)).alias("n_others"), "nearest", F.coalesce("others", F.lit("")).alias("others"))


def top_shares(rows: DataFrame, column: str, least: float = 0.001, most: int = 8) -> DataFrame:
    """The values with the largest shares of all rows, at least `least`, at most so many, ties by value."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).where(F.col("share") >= least).orderBy(F.desc("n"), column).limit(most).drop("_all")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: those with the smallest hash of seed and key, so reruns agree."""
    return rows.withColumn("_h", mix_hash(F.lit(seed), F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def claims(rows: DataFrame, entity: str, known: DataFrame, place: str, most: int = 5) -> DataFrame:
    """Entities that aren't known (unknown) or that several rows claim (shared), with the first places."""
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(place)))
    s = ranked.groupBy(entity).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(place)))).cast("array<string>"), ",").alias("places"))
    s = s.join(known.select(entity, F.lit(True).alias("_known")).distinct(), entity, "left")
    return s.withColumn("fault", F.when(F.col("_known").isNull(), "unknown").when(F.col("n") > 1, "shared")).where("fault IS NOT NULL").drop("_known")


def nearest_caption(marks: DataFrame, captions: DataFrame, page: str, reach: float) -> DataFrame:
    """Each mark (mark, page, cx, cy) with the caption (line, page, x, y, chapel) within reach on its page: one that names a chapel first, then the nearest, then the smallest line.

    Of captions at one place only the first can be chosen, and marks at one place choose
    alike, so places meet instead of rows. They look within a small distance first, and
    those that find nothing within twice as much, up to the reach; at every distance they
    meet by tiles a hair wider than it, so that rounding parts no pair.
    """
    spot = [page, "cx", "cy"]
    places = kept(captions.groupBy(page, "x", "y", F.col("chapel").isNull().alias("bare")).agg(F.min(F.struct("line", "chapel")).alias("c")))
    crowds = places.groupBy("bare", page, F.floor(F.col("x") / reach), F.floor(F.col("y") / reach)).count().groupBy("bare").agg(F.max("count").alias("n"))
    crowd = {r["bare"]: r["n"] for r in crowds.collect()}
    left = kept(marks.select(*spot).where(" AND ".join(f"`{c}` IS NOT NULL" for c in spot)).distinct())
    found = []
    for bare in sorted(crowd):
        for halvings in range(math.ceil(math.log(crowd[bare], 4)), -1, -1):
            if left.isEmpty():
                break
            got = kept(_within(left, places.where(F.col("bare") == bare), page, reach / 2**halvings))
            found.append(got)
            left = kept(left.join(got, spot, "left_anti"))
    best = reduce(DataFrame.unionByName, found, _within(left, places, page, reach).limit(0))
    best = marks.join(best, spot).groupBy("mark").agg(F.min("b").alias("b"))
    return best.select("mark", "b.c.line", "b.c.chapel", F.col("b.d").alias("distance"))


def _within(spots: DataFrame, places: DataFrame, page: str, reach: float) -> DataFrame:
    """Spots (page, cx, cy) with the first of the places (page, x, y, bare, c) within reach: b, with bare, d and c."""
    dx, dy, tile = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), reach * 1.001
    around = F.sequence(F.lit(-1), F.lit(1))
    near = spots.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).withColumns({"_tx": F.floor(F.col("cx") / tile) + F.col("_i"), "_ty": F.floor(F.col("cy") / tile) + F.col("_j")}).drop("_i", "_j")
    there = places.withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    near = near.join(there, [page, "_tx", "_ty"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach)
    return near.groupBy(page, "cx", "cy").agg(F.min(F.struct("bare", "d", "c")).alias("b"))


def text_lines(words: DataFrame, key: list[str], order: str) -> DataFrame:
    """Words (key, order, x0, y0, x1, y1, word) put together as lines: their box and their text."""
    return words.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda w: w["word"]), " ").alias("text"))


def turned(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes of a page that was read upside down, in the frame of the upright page."""
    return lines.withColumns({"x0": width - F.col("x1"), "x1": width - F.col("x0"), "y0": height - F.col("y1"), "y1": height - F.col("y0")})


def cluster_around(boxes: DataFrame, seeds: DataFrame, page: str, gap: float, tile: float = 16.0) -> DataFrame:
    """Each page's boxes (page, box, x0, y0, x1, y1) that hang together with its seed boxes over gaps of at most so much. Every round, written down, takes in what lies by the boxes of the round before; boxes meet by tiles."""

    def tiled(rows: DataFrame, wider: float) -> DataFrame:
        span = lambda k: F.explode(F.sequence(F.floor((F.col(f"{k}0") - wider) / tile), F.floor((F.col(f"{k}1") + wider) / tile)))
        return rows.withColumn("_tx", span("x")).withColumn("_ty", span("y"))

    placed = kept(tiled(boxes, 0.0))
    edge = kept(boxes.join(seeds.select(page, "box"), [page, "box"], "left_semi"))
    found = edge
    while not edge.isEmpty():
        near = " AND ".join(f"greatest(a.{k}0, b.{k}0) - least(a.{k}1, b.{k}1) <= {gap}" for k in "xy")
        beside = placed.alias("a").join(tiled(edge, gap).alias("b"), F.expr(f"a.{page} = b.{page} AND a._tx = b._tx AND a._ty = b._ty AND {near}")).select("a.*").drop("_tx", "_ty").distinct()
        edge = kept(beside.join(found.select(page, "box"), [page, "box"], "left_anti"))
        found = found.unionByName(edge)
    return found.groupBy(page).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def runs(cells: DataFrame, key: list[str], at: str, full: str) -> DataFrame:
    """Runs of neighbouring cells that are full: key, start, stop, n."""
    order = W.partitionBy(*key).orderBy(at)
    marked = cells.where(full).withColumn("_g", F.col(at) - F.row_number().over(order))
    return marked.groupBy(*key, "_g").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("n")).drop("_g")


def scale_bars(found: DataFrame, key: list[str], spread: float = 0.1, marks: tuple[int, int] = (3, 7)) -> DataFrame:
    """Of runs: keys whose runs' middles stand evenly, with their number and mean distance."""
    middle = (F.col("start") + F.col("stop")) / 2
    gaps = found.withColumn("gap", F.lead(middle).over(W.partitionBy(*key).orderBy("start")) - middle)
    s = gaps.groupBy(*key).agg(F.count("*").alias("n"), F.avg("gap").alias("gap"), F.stddev_pop("gap").alias("off"))
    return s.where((F.col("n") >= marks[0]) & (F.col("n") <= marks[1]) & (F.col("off") <= spread * F.col("gap"))).drop("off")


def band_width(cells: DataFrame, key: list[str], at: str, full: str, white: int) -> DataFrame:
    """key and width: from the first full cell to the last one before so many empty ones follow each other."""
    r = runs(cells, key, at, full)
    order = W.partitionBy(*key).orderBy("start")
    parted = r.withColumn("far", F.coalesce(F.col("start") - F.lag("stop").over(order) > white, F.lit(False))).withColumn("_b", F.sum(F.col("far").cast("int")).over(order))
    return parted.where("_b = 0").groupBy(*key).agg((F.max("stop") - F.min("start") + 1).alias("width"))


def checks(rows: list[tuple[str, Column, bool]], facts: DataFrame) -> DataFrame:
    """label, status of checks on a one-row table of facts: PASS, or FAIL (WARN where a check is soft)."""
    each = F.array(*(F.struct(F.lit(label).alias("label"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL" if hard else "WARN").alias("status")) for label, ok, hard in rows))
    return facts.select(F.explode(each).alias("c")).select("c.*")


def fingerprint(values: dict) -> Column:
    """A digest of a configuration: the same for the same values, whatever their order."""
    return F.sha2(F.to_json(F.struct(*(F.lit(values[k]).alias(k) for k in sorted(values)))), 256)


def resume(saved: DataFrame, mark: Column) -> DataFrame:
    """A checkpoint's rows without its mark; raises an error where the mark isn't this configuration's."""
    same = F.when(F.col("fingerprint") == mark, F.lit(True)).otherwise(F.raise_error(F.lit("a checkpoint of another configuration")).cast("boolean"))
    return saved.where(same).drop("fingerprint")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, in the order within their key. Ranges are sorted apart and their sizes summed, so no key is one task's work."""
    placed = kept(rows.repartitionByRange(*key, *order).withColumn("_p", F.spark_partition_id()))
    before = W.partitionBy(*key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(*key, "_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = placed.withColumn("_k", F.row_number().over(W.partitionBy(*key, "_p").orderBy(*order)))
    return local.join(starts, [*key, "_p"]).withColumn(name, F.col("_k") + F.col("_before")).drop("_k", "_before", "_p")
