"""Walls and openings: frames, azimuths, anchors, stations, targets, placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import ring_edges
from .visibility import wrapped

#: What a kind of opening means where its row leaves a cell blank.
KINDS = {"door": (True, "through"), "window": (True, "through"), "niche": (False, "in"), "apse": (False, "in")}


def blank(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) == ""


def with_kind(openings: DataFrame) -> DataFrame:
    """openings (all strings) with kind in lower case, perforates and face: the cell if it says anything, else the kind; unknown kinds have known = false."""
    o = openings.withColumn("kind", F.lower(F.trim("kind")))
    through = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[0])) for k, v in KINDS.items()))
    face = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[1])) for k, v in KINDS.items()))
    said = F.lower(F.trim("perforates"))
    return o.withColumns({"known": F.col("kind").isin(*KINDS), "perforates": F.when(blank(F.col("perforates")), through).otherwise(said.isin("true", "yes", "1")), "face": F.when(blank(F.col("face")), face).otherwise(F.lower(F.trim("face")))})


def clamp_depth(depth: Column, thickness: Column, face: Column) -> Column:
    """A pocket is at most 0.6 of its wall deep; openings through have no depth."""
    return F.when(face != "through", F.least(depth, 0.6 * thickness))


def walls(vertices: DataFrame, key: list[str], order: str) -> DataFrame:
    """Walls of counter-clockwise rings: ends, length, unit tangent, outward normal, compass azimuth (one decimal) and midpoint (two)."""
    e = ring_edges(vertices, key, order)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    e = e.withColumn("length", F.sqrt(dx * dx + dy * dy)).where("length > 0")
    e = e.withColumns({"ux": dx / F.col("length"), "uy": dy / F.col("length")})
    return e.withColumns({"nx": F.col("uy"), "ny": -F.col("ux"), "azimuth": F.bround(F.pmod(F.degrees(F.atan2(dy, -dx)), F.lit(360.0)), 1), "mx": F.bround((F.col("x0") + F.col("x1")) / 2, 2), "my": F.bround((F.col("y0") + F.col("y1")) / 2, 2)})


def rotate_to_lowest(vertices: DataFrame, key: list[str], order: str) -> DataFrame:
    """vertices numbered anew from the lowest (x, y) of each ring."""
    n = F.count("*").over(W.partitionBy(*key))
    lowest = F.min_by(order, F.struct("x", "y")).over(W.partitionBy(*key))
    return vertices.withColumn(order, F.pmod(F.col(order) - lowest, n))


def wall_for_azimuth(wall_rows: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """For each asked (key, azimuth) the wall that faces nearest to it, the error, and that of the next best (180 for a lone wall)."""
    joined = asked.withColumnRenamed("azimuth", "asked").join(wall_rows.select(*key, "edge", "azimuth"), key).withColumn("error", wrapped(F.col("azimuth"), F.col("asked")))
    order = W.partitionBy(*key, "asked").orderBy("error", "edge")
    ranked = joined.withColumns({"k": F.row_number().over(order), "runner_up": F.coalesce(F.lead("error").over(order), F.lit(180.0))})
    return ranked.where("k = 1").select(*key, "asked", "edge", "error", "runner_up")


def resolve_anchor(rows: DataFrame, wall_rows: DataFrame, key: list[str]) -> DataFrame:
    """Each opening's wall, whatever has been renumbered since: rows have id, wall, wall_az, wall_mx, wall_my.

    Without an anchor the number holds. Else the wall within 5 degrees and 0.5 m of it;
    else the nearest midpoint within 2 m, with a warning; else none.
    """
    w = wall_rows.select(*key, "edge", "azimuth", "mx", "my")
    d = F.sqrt((F.col("mx") - F.col("wall_mx")) * (F.col("mx") - F.col("wall_mx")) + (F.col("my") - F.col("wall_my")) * (F.col("my") - F.col("wall_my")))
    near = rows.join(w, key).withColumns({"d": d, "exact": (wrapped(F.col("azimuth"), F.col("wall_az")) <= 5) & (d <= 0.5)})
    best = near.where("wall_az IS NOT NULL AND (exact OR d <= 2)").groupBy("id").agg(F.min(F.struct(~F.col("exact"), "d", "edge", "exact")).alias("b"))
    out = rows.join(best, "id", "left")
    plain = F.col("wall_az").isNull()
    return out.select(*rows.columns, F.when(plain, F.col("wall")).otherwise(F.col("b.edge")).alias("edge"), F.when(plain, "unanchored").when(F.col("b.exact"), "matched").when(F.col("b").isNotNull(), "drifted").otherwise("lost").alias("status"))


def stations(placed: DataFrame, out: float = 1.5, up: float = 1.5) -> DataFrame:
    """A standing point before each opening (x0, y0, ux, uy, nx, ny, s, ground, z0, z1): out metres off the wall, and the opening's centre."""
    cx, cy = F.col("x0") + F.col("ux") * F.col("s"), F.col("y0") + F.col("uy") * F.col("s")
    return placed.where("z1 > z0").withColumns({"cx": cx, "cy": cy, "cz": (F.col("z0") + F.col("z1")) / 2}).withColumns({"ex": F.col("cx") + F.col("nx") * out, "ey": F.col("cy") + F.col("ny") * out, "ez": F.col("ground") + up})


def axis_offset(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Degrees between two directions."""
    norm = F.sqrt(ax * ax + ay * ay + az * az) * F.sqrt(bx * bx + by * by + bz * bz)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(ax * bx + ay * by + az * bz, norm)))))


def recess_target(depth: Column, thickness: Column, x: Column, y: Column, nx: Column, ny: Column) -> Column:
    """The middle of a pocket, inwards from a point on the wall's inner face; null for pockets without depth or wall."""
    inside = thickness - depth / 2
    return F.when((depth > 0) & (thickness > 0), F.struct((x - nx * inside).alias("x"), (y - ny * inside).alias("y")))


def spaced(length: Column, n: Column) -> Column:
    """Places of n openings evenly along a wall."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: length * i / (n + 1))


def facing_wall(wall_rows: DataFrame, door: DataFrame, key: list[str]) -> DataFrame:
    """The wall most parallel to each door's (key, edge, nx, ny), the first of equals."""
    d = door.select(*key, F.col("edge").alias("door"), F.col("nx").alias("dx"), F.col("ny").alias("dy"))
    w = wall_rows.join(d, key).where("edge <> door").withColumn("dot", F.abs(F.col("nx") * F.col("dx") + F.col("ny") * F.col("dy")))
    return w.groupBy(*key, "door").agg(F.max(F.struct("dot", -F.col("edge"))).alias("m"), F.max_by("edge", F.struct("dot", -F.col("edge"))).alias("facing")).drop("m")
