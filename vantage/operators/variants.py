"""Line of sight in variants of one scene, marching again only what a change can reach.

A variant is a surface and some parts, of which each is a set of triangles. The first
variant is run in full. Of another, the cells and triangles that differ are put into boxes;
a line of sight that passes through none of them has the first variant's verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mesh as ms
from .grid import Grid, corners
from .scratch import kept
from .visibility import line_of_sight

Variants = dict[str, tuple[str, tuple[str, ...]]]
#: Cells of a surface are boxed by blocks of so many rows and columns.
BLOCK = 4
#: Wider than the tolerances of either test of sight.
PAD = 1e-3
DEEP = -1e18


def _of_variants(parts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The triangles (part, bid, tri, corners) of pairs of a variant and a part, with variant instead of part."""
    named = parts.sparkSession.createDataFrame(pairs, "variant string, part string")
    # numbers of triangles needn't differ between parts
    return parts.join(F.broadcast(named), "part").drop("part")


def scene_sights(rays: DataFrame, keys: list[str], grid: Grid, surfaces: dict[str, DataFrame], parts: DataFrame, variants: Variants, tile: float = 8.0) -> DataFrame:
    """variant, keys, visible of rays (variant, keys, ex..ez, tx..tz) in full: over the variant's surface, past the triangles of its parts."""
    own = ["variant", *keys]
    seen = []
    for name in {s for s, _ in variants.values()}:
        there = [v for v, (s, _) in variants.items() if s == name]
        seen.append(line_of_sight(rays.where(F.col("variant").isin(there)), corners(surfaces[name]), grid, own).select(*own, "ex", "ey", "ez", "tx", "ty", "tz", "visible"))
    ground = kept(reduce(DataFrame.unionByName, seen))
    solid = _of_variants(parts, [(v, p) for v, (_, some) in variants.items() for p in some])
    cut = ms.blocked(ground.where("visible").drop("visible"), solid, own, tile, within=("variant",))
    return ground.join(cut.withColumn("_cut", F.lit(True)), own, "left").select(*own, (F.col("visible") & F.col("_cut").isNull()).alias("visible"))


def _cell_boxes(before: DataFrame, after: DataFrame, grid: Grid) -> DataFrame:
    """Boxes round the cells whose height differs: as wide as their samples, from below up to the tallest height that such a sample can have in either surface."""
    both = before.select("r", "c", F.col("z").alias("_a")).join(after.select("r", "c", F.col("z").alias("_b")), ["r", "c"], "full")
    off = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("r", "c")
    near = F.array(*map(F.lit, (-1, 0, 1)))
    beside = off.withColumns({"_r": F.col("r"), "_c": F.col("c")}).withColumn("_dr", F.explode(near)).withColumn("_dc", F.explode(near))
    beside = beside.select("_r", "_c", (F.col("_r") + F.col("_dr")).alias("r"), (F.col("_c") + F.col("_dc")).alias("c"))
    tall = beside.join(both.select("r", "c", F.greatest("_a", "_b").alias("_z")), ["r", "c"])
    x, y = grid.x(F.col("_c").cast("double")), grid.y(F.col("_r").cast("double"))
    wide, deep = abs(grid.a) + PAD, abs(grid.e) + PAD
    block = [F.floor(F.col(k) / BLOCK).alias(f"_b{k}") for k in ("_r", "_c")]
    ends = [(F.min(x) - wide).alias("lo_x"), (F.max(x) + wide).alias("hi_x"), (F.min(y) - deep).alias("lo_y"), (F.max(y) + deep).alias("hi_y"), F.lit(DEEP).alias("lo_z"), (F.max("_z") + PAD).alias("hi_z")]
    return tall.groupBy(*block).agg(*ends).drop("_b_r", "_b_c")


def changes(grid: Grid, surfaces: dict[str, DataFrame], parts: DataFrame, variants: Variants, tile: float = 8.0) -> DataFrame:
    """variant, lo_x..hi_z: boxes round all in which a variant differs from the first one."""
    first, *others = variants
    surface, own = variants[first]
    spans = ["lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z"]
    pairs = [(v, p) for v in others for p in sorted(set(own) ^ set(variants[v][1]))]
    centre = lambda k: F.floor((F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / (3 * tile))
    solid = _of_variants(parts, pairs).withColumns({"_cx": centre("x"), "_cy": centre("y")})
    boxes = ms.boxes(solid, ["variant", "bid", "_cx", "_cy"])
    found = [boxes.select("variant", *((F.col(c) + (PAD if c[:2] == "hi" else -PAD)).alias(c) for c in spans))]
    for name in {variants[v][0] for v in others} - {surface}:
        there = F.explode(F.array(*(F.lit(v) for v in others if variants[v][0] == name))).alias("variant")
        found.append(_cell_boxes(surfaces[surface], surfaces[name], grid).select(there, *spans))
    return reduce(DataFrame.unionByName, found)


def passes() -> Column:
    """Predicate on a row with a segment (ex..ez, tx..tz) and a box (lo_x..hi_z): the one goes through the other."""
    enter, leave, fine = F.lit(0.0), F.lit(1.0), F.lit(True)
    for k in "xyz":
        e, d, lo, hi = F.col("e" + k), F.col("t" + k) - F.col("e" + k), F.col("lo_" + k), F.col("hi_" + k)
        safe = F.when(d != 0, d)
        a, b = (lo - e) / safe, (hi - e) / safe
        enter, leave = F.greatest(enter, F.least(a, b)), F.least(leave, F.greatest(a, b))
        fine = fine & ((d != 0) | ((e >= lo) & (e <= hi)))
    return fine & (enter <= leave)


def touched(rays: DataFrame, keys: list[str], boxes: DataFrame, tile: float = 8.0) -> DataFrame:
    """variant and keys of the rays that pass a box of that variant. Both meet by tiles; a ray counts once."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / tile), F.floor(F.greatest(a, b) / tile)))
    placed = boxes.withColumn("_gx", span("lo_x", "hi_x")).withColumn("_gy", span("lo_y", "hi_y"))
    thrown = rays.withColumn("_gx", span("ex", "tx")).withColumn("_gy", span("ey", "ty"))
    return thrown.join(placed, ["_gx", "_gy"]).where(passes()).select("variant", *keys).distinct()


def variant_sights(rays: DataFrame, keys: list[str], grid: Grid, surfaces: dict[str, DataFrame], parts: DataFrame, variants: Variants, tile: float = 8.0) -> DataFrame:
    """variant, keys, visible, again of rays (keys, ex..ez, tx..tz) in each variant, the same as by scene_sights; again marks those that were marched for it.

    Rays have the same ends in all variants. surfaces are (r, c, z) by name, parts are
    triangles (part, bid, tri, ax..cz), variants name a surface and parts each, the first
    one of which the others differ from as little as may be. Rays with a null end are seen
    nowhere. Of a ray with null keys nothing is promised but that it has a row a variant.
    """
    first, *others = variants
    thrown = kept(rays.select(*keys, "ex", "ey", "ez", "tx", "ty", "tz"))
    whole = kept(scene_sights(thrown.withColumn("variant", F.lit(first)), keys, grid, surfaces, parts, {first: variants[first]}, tile))
    if not others:
        return whole.withColumn("again", F.lit(True))
    reached = touched(thrown, keys, changes(grid, surfaces, parts, variants, tile), tile)
    anew = scene_sights(kept(thrown.join(reached, keys)), keys, grid, surfaces, parts, {v: variants[v] for v in others}, tile)
    copies = whole.withColumn("variant", F.explode(F.array(*map(F.lit, others))))
    both = copies.join(anew.withColumnRenamed("visible", "_v"), ["variant", *keys], "left")
    rest = both.select("variant", *keys, F.coalesce("_v", "visible").alias("visible"), F.col("_v").isNotNull().alias("again"))
    return whole.withColumn("again", F.lit(True)).unionByName(rest)
