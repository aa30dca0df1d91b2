"""Range, nearest and containment joins over points, segments and rectangles, by tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import shuffled


def _tiled(points: DataFrame, x: str, y: str, size: float, spread: bool) -> DataFrame:
    bx, by = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not spread:
        return points.withColumns({"_bx": bx, "_by": by})
    around = F.sequence(F.lit(-1), F.lit(1))
    return points.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).withColumns({"_bx": bx + F.col("_i"), "_by": by + F.col("_j")}).drop("_i", "_j")


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (.., lx, ly) and right (.., rx, ry) no farther apart than radius, with dist. A left point looks into nine tiles of side radius."""
    dx, dy = F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")
    near = _tiled(left, "lx", "ly", radius, True).join(_tiled(right, "rx", "ry", radius, False), ["_bx", "_by"]).drop("_bx", "_by")
    return near.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def nearest_segment(points: DataFrame, segments: DataFrame, key: str, seg: str, cutoff: float) -> DataFrame:
    """Each point (key, px, py) with its nearest segment (seg, x0, y0, x1, y1) within cutoff, smallest id of equals.

    Of segments at one place only the first can be chosen, so places meet points.
    """
    segments = segments.groupBy("x0", "y0", "x1", "y1").agg(F.min(seg).alias(seg))
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - cutoff) / cutoff), F.floor((F.greatest(a, b) + cutoff) / cutoff))
    tiles = segments.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("y0", "y1")))
    dist = segment_distance(*(F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1")))
    near = _tiled(points, "px", "py", cutoff, False).join(shuffled(tiles), ["_bx", "_by"]).withColumn("dist", dist).where(F.col("dist") <= cutoff)
    return near.groupBy(key).agg(F.min(F.struct("dist", seg)).alias("m")).select(key, F.col(f"m.{seg}").alias(seg), F.col("m.dist").alias("dist"))


def points_in_polygons(points: DataFrame, edges: DataFrame, key: str, poly: str, tile: float = 4.0) -> DataFrame:
    """(key, poly) where a point (px, py) lies in a polygon given by its edges (poly, x0, y0, x1, y1), by the parity of crossings.

    There are as many rows as there are such pairs; polygons_round() counts without them.
    """
    box = edges.groupBy(poly).agg(F.min(F.least("x0", "x1")).alias("lx"), F.max(F.greatest("x0", "x1")).alias("hx"), F.min(F.least("y0", "y1")).alias("ly"), F.max(F.greatest("y0", "y1")).alias("hy"))
    tiles = box.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("lx") / tile), F.floor(F.col("hx") / tile)))).withColumn("_by", F.explode(F.sequence(F.floor(F.col("ly") / tile), F.floor(F.col("hy") / tile))))
    near = _tiled(points, "px", "py", tile, False).join(shuffled(tiles), ["_bx", "_by"]).where("px >= lx AND px <= hx AND py >= ly AND py <= hy").select(key, "px", "py", poly)
    crosses = ((F.col("y0") > F.col("py")) != (F.col("y1") > F.col("py"))) & (F.col("px") < (F.col("x1") - F.col("x0")) * (F.col("py") - F.col("y0")) / F.when(F.col("y1") != F.col("y0"), F.col("y1") - F.col("y0")) + F.col("x0"))
    return near.join(shuffled(edges), poly).groupBy(key, poly).agg(F.count_if(crosses).alias("n")).where("n % 2 = 1").select(key, poly)


def polygons_round(points: DataFrame, edges: DataFrame, key: str, poly: str, tile: float = 4.0) -> DataFrame:
    """key, n, first: how many polygons, given by their edges, a point lies in, and the smallest id of these; only points in any. Polygons of equal edges meet points as one."""
    ends = ("x0", "y0", "x1", "y1")
    shapes = edges.groupBy(poly).agg(F.array_sort(F.collect_list(F.struct(*ends))).alias("_edges")).groupBy("_edges").agg(F.count("*").alias("_n"), F.min(poly).alias("first"))
    inside = points_in_polygons(points, shapes.select("first", F.explode("_edges").alias("_e")).select("first", *(f"_e.{c}" for c in ends)), key, "first", tile)
    return inside.join(shuffled(shapes.select("first", "_n")), "first").groupBy(key).agg(F.sum("_n").alias("n"), F.min("first").alias("first"))


def rectangles_overlap(tol: float = 0.01) -> Column:
    """Whether spans (a_s0, a_s1, a_z0, a_z1) and (b_..) overlap by more than tol both ways."""
    both = lambda lo, hi: F.least(f"a_{hi}", f"b_{hi}") - F.greatest(f"a_{lo}", f"b_{lo}") > tol
    return both("s0", "s1") & both("z0", "z1")


def overlap_conflicts(openings: DataFrame, group: list[str], seq: str) -> DataFrame:
    """Pairs of openings (group, seq, s0, s1, z0, z1, face, depth, thickness) of one wall that can't both be built.

    Openings through the wall clash with any that overlap; pockets of one face with each
    other; pockets of opposite faces if their depths together reach the wall's thickness.
    """
    cols = [seq, "s0", "s1", "z0", "z1", "face", "depth", "thickness"]
    a = openings.select(*group, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = openings.select(*group, *(F.col(c).alias(f"b_{c}") for c in cols))
    opposite = (F.col("a_face") != "through") & (F.col("b_face") != "through") & (F.col("a_face") != F.col("b_face"))
    clash = F.when(opposite, F.col("a_depth") + F.col("b_depth") >= F.col("a_thickness")).otherwise(True)
    return a.join(b, group).where((F.col(f"a_{seq}") < F.col(f"b_{seq}")) & rectangles_overlap() & clash).select(*group, f"a_{seq}", f"b_{seq}")
