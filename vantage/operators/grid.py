"""Gridded heights: sampling, windows, shading, burning polygons in, overlays.

A grid is a table (r, c, z) with z null where there is no data, and a Grid header. Rows
run against y. A sample is bilinear over the four cells around it and exists only where
all four do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Header: the origin's corner, cell steps a (x) and e (y, negative), size."""

    x0: float = 0.0
    y0: float = 0.0
    a: float = 1.0
    e: float = -1.0
    h: int = 64
    w: int = 64

    def column(self, x: Column) -> Column:
        """Fractional column of a world x, cell centres at whole numbers."""
        return (x - self.x0) / self.a - 0.5

    def row(self, y: Column) -> Column:
        return (y - self.y0) / self.e - 0.5

    def x(self, c: Column) -> Column:
        return self.x0 + (c + 0.5) * self.a

    def y(self, r: Column) -> Column:
        return self.y0 + (r + 0.5) * self.e


def crop(dem: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of a window, ends inclusive; the scan prunes by both ranges."""
    return dem.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def corners(dem: DataFrame) -> DataFrame:
    """(r, c, z00, z01, z10, z11) where all four cells have data: an inner join on it is the validity test."""
    valid = dem.where("z IS NOT NULL").select("r", "c", "z")
    shares = F.array(F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc")), F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(1).alias("dc")))
    spread = valid.withColumn("s", F.explode(shares)).select((F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"), "z")
    at = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("z")))
    packed = spread.groupBy("r", "c").agg(F.count("*").alias("n"), at(0, 0).alias("z00"), at(0, 1).alias("z01"), at(1, 0).alias("z10"), at(1, 1).alias("z11"))
    return packed.where("n = 4").drop("n")


def bilinear(points: DataFrame, four: DataFrame, grid: Grid, x: str = "x", y: str = "y", out: str = "z") -> DataFrame:
    """points with the surface height at (x, y), null where there is none."""
    rf, cf = grid.row(F.col(y)), grid.column(F.col(x))
    keyed = points.withColumns({"_rf": rf, "_cf": cf}).withColumns({"_r": F.floor("_rf").cast("int"), "_c": F.floor("_cf").cast("int")})
    joined = keyed.join(four.withColumnsRenamed({"r": "_r", "c": "_c"}), ["_r", "_c"], "left")
    wr, wc = F.col("_rf") - F.col("_r"), F.col("_cf") - F.col("_c")
    z = (F.col("z00") * (1 - wc) + F.col("z01") * wc) * (1 - wr) + (F.col("z10") * (1 - wc) + F.col("z11") * wc) * wr
    return joined.withColumn(out, z).drop("_rf", "_cf", "_r", "_c", "z00", "z01", "z10", "z11")


def nearest(points: DataFrame, dem: DataFrame, grid: Grid, x: str = "x", y: str = "y", out: str = "z") -> DataFrame:
    """points with the height of the cell that holds (x, y), null outside."""
    keyed = points.withColumns({"_r": F.floor((F.col(y) - grid.y0) / grid.e).cast("int"), "_c": F.floor((F.col(x) - grid.x0) / grid.a).cast("int")})
    return keyed.join(dem.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("z").alias(out)), ["_r", "_c"], "left").drop("_r", "_c")


def gradient(dem: DataFrame, step: float = 1.0) -> DataFrame:
    """dz/dr and dz/dc by central differences, one-sided at edges and beside missing cells."""
    across, down = W.partitionBy("r").orderBy("c"), W.partitionBy("c").orderBy("r")

    def slope(w, at: str) -> Column:
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag("z").over(w))
        after = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("z").over(w))
        return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * step)).otherwise(F.coalesce((after - F.col("z")) / step, (F.col("z") - before) / step))

    return dem.where("z IS NOT NULL").select("r", "c", "z", slope(down, "r").alias("gr"), slope(across, "c").alias("gc"))


def hillshade(dem: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, step: float = 1.0) -> DataFrame:
    """Lambert shade in [0, 1] of each cell with both gradients; step: the cells' width."""
    az, alt = F.radians(F.lit(360.0 - azimuth + 90.0)), F.radians(F.lit(altitude))
    slope = F.atan(F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc")))
    aspect = F.atan2(-F.col("gc"), F.col("gr"))
    shade = F.sin(alt) * F.cos(slope) + F.cos(alt) * F.sin(slope) * F.cos(az - aspect)
    return gradient(dem, step).where("gr IS NOT NULL AND gc IS NOT NULL").select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("shade"))


def cells_in_rectangles(dem: DataFrame, rects: DataFrame, grid: Grid, tile: int = 16) -> DataFrame:
    """(id, r, c, z) of cells whose centre lies in an axis-aligned footprint (id, x0, y0, x1, y1). Rectangles meet cells by tile, not by all pairs."""
    x, y = grid.x(F.col("c").cast("double")), grid.y(F.col("r").cast("double"))
    cells = dem.withColumns({"px": x, "py": y}).withColumns({"tx": F.floor(F.col("px") / tile), "ty": F.floor(F.col("py") / tile)})
    tiled = rects.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / tile), F.floor(F.col("y1") / tile))))
    return cells.join(tiled, ["tx", "ty"]).where("px >= x0 AND px < x1 AND py >= y0 AND py < y1").drop("tx", "ty", "px", "py", "x0", "y0", "x1", "y1")


def rasterize(dem: DataFrame, rects: DataFrame, grid: Grid) -> DataFrame:
    """Each cell with the tallest footprint over it (smallest id of equals), its height and the raised surface."""
    top = cells_in_rectangles(dem, rects, grid).groupBy("r", "c").agg(F.max("height").alias("height"), F.max_by("id", F.struct("height", -F.col("id"))).alias("id"))
    return dem.join(top, ["r", "c"], "left").withColumn("raised", F.col("z") + F.coalesce("height", F.lit(0)))


def dome_overlay(dem: DataFrame, domes: DataFrame, grid: Grid) -> DataFrame:
    """dem with z raised to the caps of the domes (x, y, radius, spring) over it; overlapping caps take the highest."""
    tile = 8
    x, y = grid.x(F.col("c").cast("double")), grid.y(F.col("r").cast("double"))
    cells = dem.where("z IS NOT NULL").withColumns({"px": x, "py": y}).withColumns({"tx": F.floor(F.col("px") / tile), "ty": F.floor(F.col("py") / tile)})
    spread = domes.withColumn("tx", F.explode(F.sequence(F.floor((F.col("x") - F.col("radius")) / tile), F.floor((F.col("x") + F.col("radius")) / tile))))
    spread = spread.withColumn("ty", F.explode(F.sequence(F.floor((F.col("y") - F.col("radius")) / tile), F.floor((F.col("y") + F.col("radius")) / tile))))
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    caps = cells.join(spread, ["tx", "ty"]).withColumn("d2", d2).where("d2 <= radius * radius").groupBy("r", "c").agg(F.max(F.col("spring") + F.sqrt(F.col("radius") * F.col("radius") - F.col("d2"))).alias("cap"))
    return dem.join(caps, ["r", "c"], "left").select("r", "c", F.when(F.col("z").isNotNull(), F.greatest(F.col("z").cast("double"), F.coalesce("cap", F.col("z").cast("double")))).alias("z"))


def stretch(table: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """value scaled to [0, 1] between two percentiles, clipped."""
    ends = table.agg(F.percentile(value, low).alias("_low"), F.percentile(value, high).alias("_high"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return table.join(F.broadcast(ends)).withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("_low", "_high")
