"""Line of sight over a gridded surface: viewsheds, cones, volumes, graphs, first hits.

A ray goes from an eye to a target. It is sampled every step between d_min from the eye
and d_min before the target; the target is visible if it stands as high, seen from the
eye, as every sample with data, up to a tolerance. Targets nearer than d_min are visible,
a target straight above or below the eye is not.

Rays are rows keyed by (eye, target). A surface of up to SURFACE_CELLS cells, counted
first, goes to all executors, and a ray is marched over it inside a task, so nothing but
rays moves. A larger one is cut into tiles, and pieces of rays meet the tiles that they
cross (tiles.py), so the shuffle grows with rays and tiles, not with samples. The plain
form, samples as rows that meet the surface in an equi-join, is what tests hold both
against. All ways use the same numbers in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .grid import Grid, bilinear
from .scratch import shuffled
from .surface import EPS, SAMPLES, Surface, small_surface

def _marched(rays: DataFrame, surface: Surface, grid: Grid, step: float, d_min: float) -> DataFrame:
    """rays with dist and visible, by a march in each task."""
    shared = rays.sparkSession.sparkContext.broadcast(surface)
    first = max(1, -(-int(d_min * 1_000_000) // int(step * 1_000_000)))
    names = [c for c in rays.columns if c not in ("dist", "visible")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ground = shared.value
        for batch in batches:
            ex, ey, ez, tx, ty, tz = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("ex", "ey", "ez", "tx", "ty", "tz"))
            dx, dy = tx - ex, ty - ey
            dist = np.sqrt(dx * dx + dy * dy)
            last = np.floor((np.nan_to_num(dist) - d_min) / step).astype(np.int64)
            n = np.maximum(last - first + 1, 0)
            horizon = np.full(len(n), -np.inf)
            upto = np.concatenate(([0], np.cumsum(n)))
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + SAMPLES, "right")) - 1)
                ray = np.repeat(np.arange(a, b), n[a:b])
                if len(ray):
                    d = (first + np.arange(upto[a], upto[b]) - upto[ray]) * step
                    x, y = ex[ray] + dx[ray] / dist[ray] * d, ey[ray] + dy[ray] / dist[ray] * d
                    angle = (ground.at((y - grid.y0) / grid.e - 0.5, (x - grid.x0) / grid.a - 0.5) - ez[ray]) / d
                    np.maximum.at(horizon, ray, np.where(np.isnan(angle), -np.inf, angle))
                a = b
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = (dist < d_min) | np.isneginf(horizon) | ((tz - ez) / dist >= horizon - EPS)
            visible = (dist > 0) & ~np.isnan(tz) & seen
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(dist), pa.array(visible)], [*names, "dist", "visible"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rays.select(*names).schema)
    return rays.select(*names).mapInArrow(run, f"{kinds}, dist double, visible boolean")


def line_of_sight(rays: DataFrame, four: DataFrame, grid: Grid, keys: list[str], step: float = 1.0, d_min: float = 1.0, surface: Surface | None = None) -> DataFrame:
    """rays (keys, ex, ey, ez, tx, ty, tz) with dist and visible. surface: what small_surface() gave, for several calls on one."""
    surface = surface or small_surface(four)
    return _marched(rays, surface, grid, step, d_min) if surface else tiles.line_of_sight(rays, tiles.tiled(four), grid, keys, step, d_min)


def _joined(rays: DataFrame, four: DataFrame, grid: Grid, keys: list[str], step: float, d_min: float) -> DataFrame:
    """rays with dist and visible, by a join of their samples with the surface."""
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    rays = rays.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    first = max(1, -(-int(d_min * 1_000_000) // int(step * 1_000_000)))
    last = F.floor((F.col("dist") - d_min) / step).cast("int")
    samples = rays.where(last >= first).withColumn("_k", F.explode(F.sequence(F.lit(first), last)))
    at = F.col("_k") * step
    samples = samples.select(*keys, "ez", at.alias("d"), (F.col("ex") + dx / F.col("dist") * at).alias("x"), (F.col("ey") + dy / F.col("dist") * at).alias("y"))
    angles = bilinear(samples, four, grid).where("z IS NOT NULL").groupBy(*keys).agg(F.max((F.col("z") - F.col("ez")) / F.col("d")).alias("horizon"))
    seen = (F.col("dist") < d_min) | F.col("horizon").isNull() | ((F.col("tz") - F.col("ez")) / F.col("dist") >= F.col("horizon") - EPS)
    return rays.join(angles, keys, "left").withColumn("visible", (F.col("dist") > 0) & F.col("tz").isNotNull() & F.when(F.col("dist") > 0, seen).otherwise(False)).drop("horizon")


def eye_cells(eyes: DataFrame, dem: DataFrame, grid: Grid, radius: float, height: float = 0.0) -> DataFrame:
    """Rays from each eye (eye, ex, ey, ez) to the cells within radius, met by tiles as wide as it."""
    tx, ty = grid.x(F.col("c").cast("double")), grid.y(F.col("r").cast("double"))
    cells = dem.select("r", "c", tx.alias("tx"), ty.alias("ty"), (F.col("z") + height).alias("tz")).withColumns({"bx": F.floor(F.col("tx") / radius), "by": F.floor(F.col("ty") / radius)})
    around = F.sequence(F.lit(-1), F.lit(1))
    near = eyes.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"bx": F.floor(F.col("ex") / radius) + F.col("i"), "by": F.floor(F.col("ey") / radius) + F.col("j")}).drop("i", "j")
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    return near.join(cells, ["bx", "by"]).where(dx * dx + dy * dy <= radius * radius).drop("bx", "by")


def viewshed(eyes: DataFrame, dem: DataFrame, four: DataFrame, grid: Grid, radius: float, height: float = 0.0) -> DataFrame:
    """(eye, r, c, dist, visible, value): value is 255 where the cell has no data, else 1 or 0."""
    seen = line_of_sight(eye_cells(eyes, dem, grid, radius, height), four, grid, ["eye", "r", "c"])
    return seen.withColumn("value", F.when(F.col("tz").isNull(), 255).when(F.col("visible"), 1).otherwise(0))


def bearing(dx, dy):
    """Compass degrees of a direction."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def wrapped(a, b):
    """Angle between two bearings, up to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def in_cone(azimuth: float | None, fov: float, pitch: float = 0.0, vfov: float = 180.0, free_at_eye: bool = True):
    """Predicate on a ray: within fov of an azimuth and vfov of a pitch. Rasters exempt the eye's own cell from the azimuth, volumes don't."""
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    fine = F.lit(True)
    if azimuth is not None and fov < 360:
        fine = fine & ((wrapped(bearing(dx, dy), F.lit(azimuth)) <= fov / 2) | (F.lit(free_at_eye) & (F.col("dist") == 0)))
    if vfov < 180:
        fine = fine & (F.abs(F.degrees(F.atan2(F.col("tz") - F.col("ez"), F.col("dist"))) - pitch) <= vfov / 2)
    return fine


def volume(eyes: DataFrame, dem: DataFrame, four: DataFrame, grid: Grid, radius: float, levels: list[float]) -> DataFrame:
    """(eye, r, c, level, visible) over points at fixed heights above the ground of each cell."""
    rays = eye_cells(eyes, dem.where("z IS NOT NULL"), grid, radius).withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("tz", F.col("tz") + F.col("level"))
    return line_of_sight(rays, four, grid, ["eye", "r", "c", "level"])


def _hit_between(rays: DataFrame, k: Column, f: Column, before: Column, step: float) -> DataFrame:
    """rays with hit: between step k - 1 and step k, by the clearances before and at it."""
    q = (k - 1) * step
    gap = before - f
    t = F.when(F.abs(gap) > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), before / gap))).otherwise(1.0)
    return rays.withColumn("hit", F.when(k.isNotNull(), q + t * (k * step - q)))


def first_hit(rays: DataFrame, four: DataFrame, grid: Grid, keys: list[str], max_range: float, step: float = 1.0, surface: Surface | None = None) -> DataFrame:
    """rays (keys, ex, ey, ez, ux, uy, slope, f0) with hit, the distance at which the ray meets the surface, null for a miss.

    f0 is the surface minus the eye at the start, -1 where that is unknown. The hit is put between the step before and
    the first step at or under the surface, by the clearances at that step and at the last one with data.
    """
    surface = surface or small_surface(four)
    last = int(max_range / step)
    met = _met(rays, surface, grid, step, last) if surface else tiles.first_hit(rays, tiles.tiled(four), grid, keys, step, last)
    return _hit_met(met, step)


def first_hit_by_tiles(rays: DataFrame, surface: DataFrame, grid: Grid, keys: list[str], max_range: float, step: float = 1.0) -> DataFrame:
    """first_hit() over a surface that is in tiles already."""
    return _hit_met(tiles.first_hit(rays, surface, grid, keys, step, int(max_range / step)), step)


def _hit_met(met: DataFrame, step: float) -> DataFrame:
    return _hit_between(met, F.col("_k"), F.col("_f"), F.coalesce("_before", "f0"), step).drop("_k", "_f", "_before")


def _met(rays: DataFrame, surface: Surface, grid: Grid, step: float, last: int) -> DataFrame:
    """rays with the first step at or under the surface, the clearance there and at the last step with data before it, by a march in each task that stops where nothing is left to meet."""
    shared = rays.sparkSession.sparkContext.broadcast(surface)
    names = rays.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ground = shared.value
        for batch in batches:
            ex, ey, ez, ux, uy, slope = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("ex", "ey", "ez", "ux", "uy", "slope"))
            k, f, before = np.zeros(len(ex), np.int64), np.full(len(ex), np.nan), np.full(len(ex), np.nan)
            going, at = np.arange(len(ex)), 1
            while at <= last and len(going):
                n = max(1, min(last - at + 1, SAMPLES // len(going)))
                found, clear, tail, _ = tiles.met_in(ground, grid, step, ex[going], ey[going], ez[going], ux[going], uy[going], slope[going], np.full(len(going), at), np.full(len(going), at + n - 1))
                hit = found > 0
                k[going], f[going] = found, clear
                before[going] = np.where(np.isnan(tail), before[going], tail)
                going, at = going[~hit], at + n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(k, mask=k == 0), pa.array(f, mask=k == 0), pa.array(before, mask=np.isnan(before))], [*names, "_k", "_f", "_before"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rays.schema)
    return rays.mapInArrow(run, f"{kinds}, _k long, _f double, _before double")


def _joined_hits(rays: DataFrame, four: DataFrame, grid: Grid, keys: list[str], max_range: float, step: float = 1.0) -> DataFrame:
    """first_hit() by a join of all samples with the surface."""
    samples = rays.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(int(max_range / step)))))
    d = F.col("_k") * step
    samples = samples.select(*keys, "ez", "slope", "_k", d.alias("d"), (F.col("ex") + F.col("ux") * d).alias("x"), (F.col("ey") + F.col("uy") * d).alias("y"))
    f = bilinear(samples, four, grid).where("z IS NOT NULL").withColumn("f", F.col("z") - (F.col("ez") + F.col("slope") * F.col("d")))
    hit = f.where("f >= 0").groupBy(*keys).agg(F.min(F.struct("_k", "f")).alias("h"))
    before = f.alias("s").join(hit, keys).where("s._k < h._k").groupBy(*keys).agg(F.max(F.struct("_k", F.col("s.f").alias("f"))).alias("p"))
    out = rays.join(hit, keys, "left").join(before, keys, "left")
    return _hit_between(out, F.col("h._k"), F.col("h.f"), F.coalesce("p.f", "f0"), step).drop("h", "p")


def viewgraph(eyes: DataFrame, buildings: DataFrame, four: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Edges eye -> building within radius: centroid or any vertex visible. buildings: id, cx, cy, tz and vertices array<struct<x,y>>."""
    around = F.sequence(F.lit(-1), F.lit(1))
    near = eyes.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"bx": F.floor(F.col("ex") / radius) + F.col("i"), "by": F.floor(F.col("ey") / radius) + F.col("j")}).drop("i", "j")
    keyed = buildings.withColumns({"bx": F.floor(F.col("cx") / radius), "by": F.floor(F.col("cy") / radius)})
    d2 = (F.col("cx") - F.col("ex")) * (F.col("cx") - F.col("ex")) + (F.col("cy") - F.col("ey")) * (F.col("cy") - F.col("ey"))
    pairs = near.join(keyed, ["bx", "by"]).where(d2 <= radius * radius).drop("bx", "by")
    points = F.concat(F.array(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))), "vertices")
    rays = pairs.select("eye", "id", "ex", "ey", "ez", "tz", F.posexplode(points).alias("v", "at")).select("eye", "id", "v", "ex", "ey", "ez", F.col("at.x").alias("tx"), F.col("at.y").alias("ty"), "tz")
    seen = line_of_sight(rays, four, grid, ["eye", "id", "v"])
    return seen.groupBy("eye", "id").agg(
        F.bool_or(F.when(F.col("v") == 0, F.col("visible"))).alias("visible"), F.bool_or("visible").alias("visible_any"), F.max(F.when(F.col("v") == 0, F.col("dist"))).alias("distance"),
        F.bround(F.max("ez"), 3).alias("eye_z"), F.bround(F.max("tz"), 3).alias("tgt_z"),
    )


def observer_pairs(eyes: DataFrame, radius: float) -> DataFrame:
    """eye, ex, ey, ez, other, tx, ty, tz of all eyes within radius of each, met by tiles as wide as it."""
    around = F.sequence(F.lit(-1), F.lit(1))
    near = eyes.select("eye", "ex", "ey", "ez").withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"bx": F.floor(F.col("ex") / radius) + F.col("i"), "by": F.floor(F.col("ey") / radius) + F.col("j")}).drop("i", "j")
    others = eyes.select(F.col("eye").alias("other"), F.col("ex").alias("tx"), F.col("ey").alias("ty"), F.col("ez").alias("tz")).withColumns({"bx": F.floor(F.col("tx") / radius), "by": F.floor(F.col("ty") / radius)})
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    return near.join(shuffled(others), ["bx", "by"]).where(dx * dx + dy * dy <= radius * radius).drop("bx", "by")


def observer_edges(eyes: DataFrame, four: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Edges eye -> other between all eyes within radius: visible (an eye sees itself), distance, and both heights."""
    seen = line_of_sight(observer_pairs(eyes, radius), four, grid, ["eye", "other"])
    return seen.select("eye", "other", ((F.col("eye") == F.col("other")) | F.col("visible")).alias("visible"), F.col("dist").alias("distance"), "ex", "ey", "ez", "tx", "ty", "tz", F.bround("ez", 3).alias("eye_z"), F.bround("tz", 3).alias("tgt_z"))


def matrix(edges: DataFrame, size: int) -> DataFrame:
    """Edges between observers as a dense matrix: one row an eye, a column for each of the first size others; true on the diagonal, false where there is no edge. For few observers."""
    wide = edges.where(F.col("other").between(1, size) & F.col("eye").between(1, size)).groupBy("eye").pivot("other", list(range(1, size + 1))).agg(F.bool_or("visible"))
    return wide.select("eye", *(F.coalesce(F.col(f"`{k}`"), F.col("eye") == k).alias(f"sees_{k}") for k in range(1, size + 1)))


def observer_sights(stations: DataFrame, four: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """eye, wall, other, visible: whether the station at each eye's wall (eye, wall, sx, sy, sz) sees the target (tx, ty, tz) of each other eye within radius, met by tiles."""
    around = F.sequence(F.lit(-1), F.lit(1))
    near = stations.select("eye", "wall", F.col("sx").alias("ex"), F.col("sy").alias("ey"), F.col("sz").alias("ez")).withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    near = near.withColumns({"bx": F.floor(F.col("ex") / radius) + F.col("i"), "by": F.floor(F.col("ey") / radius) + F.col("j")}).drop("i", "j")
    targets = stations.select(F.col("eye").alias("other"), "tx", "ty", "tz").distinct().withColumns({"bx": F.floor(F.col("tx") / radius), "by": F.floor(F.col("ty") / radius)})
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    rays = near.join(targets, ["bx", "by"]).where((F.col("eye") != F.col("other")) & (dx * dx + dy * dy <= radius * radius)).drop("bx", "by")
    return line_of_sight(rays, four, grid, ["eye", "wall", "other"]).select("eye", "wall", "other", "visible")
