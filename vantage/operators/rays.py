"""Bundles of rays: panoramas, pinhole pictures, height ladders, envelopes, and how much of a line is seen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Grid, bilinear
from .scratch import kept
from .visibility import bearing, line_of_sight, small_surface

STEEPEST = 85.0


def panorama(spark: SparkSession, azimuth: float, fov: float, pitch: float, vfov: float, width: int) -> DataFrame:
    """px, py, ux, uy, slope of an equirectangular picture; square pixels."""
    height = max(1, round(width * vfov / fov))
    grid = spark.range(width).withColumnRenamed("id", "px").join(spark.range(height).withColumnRenamed("id", "py"))
    az = F.radians(F.lit(azimuth - fov / 2) + (F.col("px") + 0.5) * (fov / width))
    el = F.lit(pitch + vfov / 2) - (F.col("py") + 0.5) * (vfov / height)
    el = F.greatest(F.lit(-STEEPEST), F.least(F.lit(STEEPEST), el))
    return grid.select("px", "py", F.sin(az).alias("ux"), F.cos(az).alias("uy"), F.tan(F.radians(el)).alias("slope"))


def basis(azimuth: float, pitch: float) -> tuple[tuple, tuple, tuple]:
    """Forward, right and up of a camera."""
    a, p = math.radians(azimuth), math.radians(pitch)
    forward = (math.sin(a) * math.cos(p), math.cos(a) * math.cos(p), math.sin(p))
    right = (math.cos(a), -math.sin(a), 0.0)
    up = (-math.sin(a) * math.sin(p), -math.cos(a) * math.sin(p), math.cos(p))
    return forward, right, up


def perspective(spark: SparkSession, azimuth: float, pitch: float, hfov: float, width: int, height: int) -> DataFrame:
    """px, py, ux, uy, slope of a pinhole picture, slopes no steeper than STEEPEST."""
    f, r, u = basis(azimuth, pitch)
    half = math.tan(math.radians(hfov / 2))
    grid = spark.range(width).withColumnRenamed("id", "px").join(spark.range(height).withColumnRenamed("id", "py"))
    a = (F.col("px") + 0.5) / width * 2 - 1
    b = (1 - (F.col("py") + 0.5) / height * 2) * (height / width)
    d = [F.lit(f[k]) + a * half * r[k] + b * half * u[k] for k in range(3)]
    flat = F.sqrt(d[0] * d[0] + d[1] * d[1])
    steep = math.tan(math.radians(STEEPEST))
    slope = F.greatest(F.lit(-steep), F.least(F.lit(steep), d[2] / F.greatest(flat, F.lit(1e-9))))
    return grid.select("px", "py", (d[0] / F.greatest(flat, F.lit(1e-9))).alias("ux"), (d[1] / F.greatest(flat, F.lit(1e-9))).alias("uy"), slope.alias("slope"))


def project(dx: Column, dy: Column, dz: Column, azimuth: float, pitch: float, hfov: float, width: int, height: int) -> Column:
    """Pixel (x, y) of a direction from the camera, null behind it or outside the frame."""
    f, r, u = basis(azimuth, pitch)
    dot = lambda v: dx * v[0] + dy * v[1] + dz * v[2]
    half = math.tan(math.radians(hfov / 2))
    depth = F.when(dot(f) > 0, dot(f))
    x = (dot(r) / depth / half + 1) / 2 * width
    y = (1 - dot(u) / depth / half / (height / width)) / 2 * height
    return F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), F.struct(x.alias("x"), y.alias("y")))


def reach(points: DataFrame, four: DataFrame, grid: Grid, keys: list[str], low: float, high: float, step: float) -> DataFrame:
    """The highest and the lowest visible rung over each point (keys, ex, ey, ez, tx, ty, base) on a ladder from base + low to base + high; null if none."""
    rungs = int(round((high - low) / step)) + 1
    rays = points.withColumn("rung", F.explode(F.sequence(F.lit(0), F.lit(rungs - 1)))).withColumn("tz", F.col("base") + low + F.col("rung") * step)
    return line_of_sight(rays, four, grid, [*keys, "rung"]).groupBy(*keys).agg(F.max(F.when(F.col("visible"), F.col("rung"))).alias("top"), F.min(F.when(F.col("visible"), F.col("rung"))).alias("bottom"))


def seen_share(lines: DataFrame, four: DataFrame, grid: Grid, keys: list[str], tol: float = 0.05, seeds: int = 9, max_depth: int = 16) -> DataFrame:
    """The visible share of each line (keys, ex, ey, ez, ax, ay, az, bx, by, bz), the visible stretches of it (lo, hi in [0, 1]), and how many edges of shadow stay unresolved.

    Probes stand at seeds even places. A stretch whose ends differ is halved while it is
    longer than tol, at most max_depth times; what still differs then is split in its
    middle. All halvings of a level are one job, whose result is written down. A shadow
    narrower than the seeds' distance can be missed; a line without length is its first end.
    """
    fine = (seeds - 1) * 2**max_depth
    surface = small_surface(four)
    d = [F.col("b" + k) - F.col("a" + k) for k in "xyz"]
    lines = lines.withColumn("length", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    ends = lines.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(fine), F.lit(2**max_depth))))

    def probe(at: DataFrame) -> DataFrame:
        t = F.col("at") / fine
        rays = at.select(*keys, "length", "at", "ex", "ey", "ez", *((F.col("a" + k) + (F.col("b" + k) - F.col("a" + k)) * t).alias("t" + k) for k in "xyz"))
        return line_of_sight(rays, four, grid, [*keys, "at"], surface=surface).select(*keys, "length", "at", "visible")

    order = W.partitionBy(*keys).orderBy("at")
    stretch = lambda known: known.withColumns({"next": F.lead("at").over(order), "other": F.lead("visible").over(order)}).where("next IS NOT NULL")
    known = kept(probe(ends))
    for _ in range(max_depth):
        wide = stretch(known).where((F.col("visible") != F.col("other")) & ((F.col("next") - F.col("at")) / fine * F.col("length") > tol))
        halves = kept(wide.select(*keys, ((F.col("at") + F.col("next")) / 2).cast("int").alias("at")))
        if halves.isEmpty():
            break
        known = known.unionByName(kept(probe(halves.join(lines, keys))))
    s = stretch(known)
    middle = (F.col("at") + F.col("next")) / 2
    lit = F.struct((F.when(F.col("visible"), F.col("at")).otherwise(middle) / fine).alias("lo"), (F.when(F.col("other"), F.col("next")).otherwise(middle) / fine).alias("hi"))
    lit = F.when(F.col("visible") | F.col("other"), lit)
    # stretches of one line that meet are one: a line has few, as only shadows' edges were halved
    join = lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["hi"] >= x["lo"] - 1e-12), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["lo"].alias("lo"), x["hi"].alias("hi"))))).otherwise(F.concat(out, F.array(x)))
    seen = s.groupBy(*keys).agg(F.array_sort(F.collect_list(lit)).alias("lit"), F.count_if(F.col("visible") != F.col("other")).alias("n_unresolved"))
    seen = seen.withColumn("stretches", F.aggregate(F.filter("lit", lambda x: x["hi"] > x["lo"]), F.array().cast("array<struct<lo:double,hi:double>>"), lambda out, x: F.when(F.size(out) == 0, F.array(x)).otherwise(join(out, x))))
    return seen.select(*keys, F.aggregate("stretches", F.lit(0.0), lambda a, x: a + x["hi"] - x["lo"]).alias("share"), "stretches", "n_unresolved")


def quad_share(quads: DataFrame, four: DataFrame, grid: Grid, keys: list[str], rows: int = 5, tol: float = 0.05, seeds: int = 9, max_depth: int = 16) -> DataFrame:
    """The visible share of upright quads (keys, ex, ey, ez, ax, ay, bx, by, z_lo, z_hi): the mean of so many rows at the middles of even heights, and their unresolved edges."""
    z = F.col("z_lo") + (F.col("z_hi") - F.col("z_lo")) * (F.col("row") + 0.5) / rows
    lines = quads.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumns({"az": z, "bz": z})
    return seen_share(lines, four, grid, [*keys, "row"], tol, seeds, max_depth).groupBy(*keys).agg(F.avg("share").alias("share"), F.sum("n_unresolved").alias("n_unresolved"))


def envelope(stands: DataFrame, targets: DataFrame, four: DataFrame, grid: Grid, keys: list[str], scene: str) -> DataFrame:
    """Mean visible share of a scene's targets (scene, t, tx, ty, tz) from each of its standing points (scene, keys, ex, ey, ez), and how many."""
    rays = stands.join(targets, scene)
    return line_of_sight(rays, four, grid, [scene, *keys, "t"]).groupBy(scene, *keys).agg(F.avg(F.col("visible").cast("double")).alias("share"), F.count("*").alias("n"))


def polar_envelope(frames: DataFrame, targets: DataFrame, four: DataFrame, grid: Grid, scene: str, ranges: tuple[float, ...], angles: tuple[float, ...], eye: float) -> DataFrame:
    """Of standing points at all ranges and angles before each door: scene, range, angle, share of the targets seen, and widest, the largest angle in plan between the door's axis and a ray that is let through; null on unknown ground.

    frames: scene, x, y (the door), nx, ny (its outward normal); targets: scene, t, tx, ty,
    tz. Angles are degrees from the normal, positive to its left.
    """
    polar = F.array(*(F.struct(F.lit(float(r)).alias("range"), F.lit(float(a)).alias("angle")) for r in ranges for a in angles))
    turn = F.radians("angle")
    stands = frames.select(scene, "x", "y", "nx", "ny", F.explode(polar).alias("_p")).select(scene, "x", "y", "nx", "ny", "_p.range", "_p.angle")
    dx, dy = F.col("nx") * F.cos(turn) - F.col("ny") * F.sin(turn), F.col("nx") * F.sin(turn) + F.col("ny") * F.cos(turn)
    stands = bilinear(stands.withColumns({"ex": F.col("x") + F.col("range") * dx, "ey": F.col("y") + F.col("range") * dy}), four, grid, "ex", "ey", "ground")
    at = [scene, "range", "angle"]
    rays = stands.where("ground IS NOT NULL").select(*at, "ex", "ey", (F.col("ground") + eye).alias("ez"), "nx", "ny").join(targets, scene)
    seen = line_of_sight(rays, four, grid, [*at, "t"])
    along = (F.col("ex") - F.col("tx")) * F.col("nx") + (F.col("ey") - F.col("ty")) * F.col("ny")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(along, F.col("dist"))))))
    sums = seen.groupBy(*at).agg(F.avg(F.col("visible").cast("double")).alias("share"), F.max(F.when(F.col("visible"), angle)).alias("widest"))
    return stands.select(*at).join(sums, at, "left")


def marks(edges: DataFrame, d_min: float = 1.0) -> DataFrame:
    """What to mark of other observers: edges (eye, other, ex, ey, ez, tx, ty, tz, visible) with bearing and elevation, those nearer than d_min left out."""
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    out = edges.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where((F.col("eye") != F.col("other")) & (F.col("dist") >= d_min))
    return out.select("eye", "other", "visible", "dist", bearing(dx, dy).alias("bearing"), F.degrees(F.atan2(F.col("tz") - F.col("ez"), F.col("dist"))).alias("elevation"))


def hit_points(hits: DataFrame) -> DataFrame:
    """hits (ex, ey, ez, ux, uy, slope, hit) with the slant range, the place hit and the elevation looked at; null for a miss."""
    d = F.col("hit")
    return hits.withColumns({"range": d * F.sqrt(1 + F.col("slope") * F.col("slope")), "hx": F.col("ex") + F.col("ux") * d, "hy": F.col("ey") + F.col("uy") * d, "hz": F.col("ez") + F.col("slope") * d, "elevation": F.degrees(F.atan("slope"))})
