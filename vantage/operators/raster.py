"""More on gridded heights: windows, polygons by scan line, fills, resampling, differences, aspects, voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Grid, bilinear
from .scratch import kept


def core_window(boxes: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """One row r0, r1, c0, c1: the cells of all boxes (x0, y0, x1, y1) and a margin, from the grid's origin on."""
    low_x, high_x, low_y, high_y = F.min("x0") - margin, F.max("x1") + margin, F.min("y0") - margin, F.max("y1") + margin
    at = lambda v: F.greatest(F.lit(0), F.floor(v)).cast("int")
    return boxes.agg(at((high_y - grid.y0) / grid.e).alias("r0"), at((low_y - grid.y0) / grid.e).alias("r1"), at((low_x - grid.x0) / grid.a).alias("c0"), at((high_x - grid.x0) / grid.a).alias("c1"))


def observer_window(eyes: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """eyes with r0, r1, c0, c1: the square of cells round each, from the grid's origin on."""
    half = F.ceil(F.lit(radius / abs(grid.a))).cast("int")
    c, r = F.floor((F.col("ex") - grid.x0) / grid.a).cast("int"), F.floor((F.col("ey") - grid.y0) / grid.e).cast("int")
    return eyes.withColumns({"r0": F.greatest(F.lit(0), r - half), "r1": r + half, "c0": F.greatest(F.lit(0), c - half), "c1": c + half})


def crop_to(dem: DataFrame, window: DataFrame, nodata: float | None = None) -> DataFrame:
    """Cells inside a one-row window (r0, r1, c0, c1); a sentinel height becomes null."""
    z = F.col("z") if nodata is None else F.when(F.col("z") != nodata, F.col("z"))
    return dem.join(F.broadcast(window.limit(1)), F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))).select("r", "c", z.alias("z"))


def polygon_cells(edges: DataFrame, grid: Grid, key: list[str], *carried: str) -> DataFrame:
    """key, carried columns, r, c: each cell whose centre lies in a polygon (key, x0, y0, x1, y1).

    Every edge is cut by the centre lines of the rows it passes; a polygon's cuts of one
    line, sorted, are where it is entered and left. So a polygon costs its height and area
    in cells, and no cell is held against a polygon that isn't there.
    """
    rf = lambda y: grid.row(y)
    a, b = F.least(rf(F.col("y0")), rf(F.col("y1"))), F.greatest(rf(F.col("y0")), rf(F.col("y1")))
    # rows run against y: a centre line on an edge's end belongs to the edge above it
    first, last = F.greatest(F.lit(0), F.floor(a) + 1).cast("int"), F.least(F.lit(grid.h - 1), F.floor(b)).cast("int")
    cut = edges.where("y0 <> y1").withColumns({"_f": first, "_l": last}).where("_f <= _l").withColumn("r", F.explode(F.sequence("_f", "_l")))
    x = F.col("x0") + (grid.y(F.col("r").cast("double")) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    order = W.partitionBy(*key, "r").orderBy("x")
    spans = cut.withColumn("x", x).withColumns({"_k": F.row_number().over(order), "out": F.lead("x").over(order)}).where("_k % 2 = 1 AND out IS NOT NULL")
    c0, c1 = F.greatest(F.lit(0), F.ceil(grid.column(F.col("x")))).cast("int"), F.least(F.lit(grid.w - 1), F.ceil(grid.column(F.col("out"))) - 1).cast("int")
    return spans.withColumns({"_a": c0, "_b": c1}).where("_a <= _b").select(*key, *carried, "r", F.explode(F.sequence("_a", "_b")).alias("c"))


def burn_polygons(edges: DataFrame, grid: Grid, value: str = "height") -> DataFrame:
    """(r, c, id, value): each cell whose centre lies in a polygon (id, x0, y0, x1, y1, value), with the tallest polygon over it (smallest id of equals)."""
    cells = polygon_cells(edges, grid, ["id"], value)
    return cells.groupBy("r", "c").agg(F.max_by("id", F.struct(F.col(value), -F.col("id"))).alias("id"), F.max(value).alias(value))


def un_extrude(dem: DataFrame, covered: DataFrame, bare: DataFrame) -> DataFrame:
    """dem with bare ground where something covers it (r, c). Both have the same grid."""
    flat = bare.join(covered.select("r", "c").distinct(), ["r", "c"], "left_semi").select("r", "c", F.col("z").alias("bare"), F.lit(True).alias("_in"))
    return dem.join(flat, ["r", "c"], "left").select("r", "c", F.when(F.col("_in"), F.col("bare")).otherwise(F.col("z")).alias("z"))


def resample(four: DataFrame, source: Grid, target: Grid, spark) -> DataFrame:
    """The surface at another grid's cell centres, null where there is none."""
    cells = spark.range(target.h * target.w).select(F.floor(F.col("id") / target.w).cast("int").alias("r"), (F.col("id") % target.w).cast("int").alias("c"))
    points = cells.withColumns({"x": target.x(F.col("c").cast("double")), "y": target.y(F.col("r").cast("double"))})
    return bilinear(points.withColumnsRenamed({"r": "tr", "c": "tc"}), four, source).select(F.col("tr").alias("r"), F.col("tc").alias("c"), "z")


def difference_stats(a: DataFrame, b: DataFrame, mask: DataFrame) -> DataFrame:
    """Median and 5th and 95th percentile of a - b, on and off the mask (r, c), and each less the median off it."""
    d = a.select("r", "c", F.col("z").alias("za")).join(b.select("r", "c", F.col("z").alias("zb")), ["r", "c"]).where("za IS NOT NULL AND zb IS NOT NULL")
    d = d.join(mask.select("r", "c", F.lit(True).alias("on")).distinct(), ["r", "c"], "left").withColumns({"on": F.coalesce("on", F.lit(False)), "d": F.col("za") - F.col("zb")})
    s = d.groupBy("on").agg(F.count("*").alias("n"), F.percentile("d", 0.5).alias("median"), F.percentile("d", 0.05).alias("p5"), F.percentile("d", 0.95).alias("p95"))
    offset = F.coalesce(F.max(F.when(~F.col("on"), F.col("median"))).over(W.partitionBy()), F.lit(0.0))
    return s.withColumn("signal", F.col("median") - offset)


def nearest_fill(dem: DataFrame, widest: int = 1 << 20) -> DataFrame:
    """dem with missing heights taken from the nearest cell that has one; of equals the first by row, then column.

    Missing cells meet cells with data by tiles as wide as the reach; what is still open
    goes on with twice the reach, so only the cells of wide holes meet many others. Cells
    with no data within widest stay null; none is left out.
    """
    known = kept(dem.where("z IS NOT NULL").select("r", "c", "z"))
    open_cells, filled, reach = dem.where("z IS NULL").select("r", "c"), known, 2
    around = F.sequence(F.lit(-1), F.lit(1))
    while reach <= widest and not known.isEmpty() and not open_cells.isEmpty():
        near = open_cells.withColumns({"i": F.explode(around)}).withColumn("j", F.explode(around)).withColumns({"tr": F.floor(F.col("r") / reach) + F.col("i"), "tc": F.floor(F.col("c") / reach) + F.col("j")})
        cells = known.select(F.col("r").alias("kr"), F.col("c").alias("kc"), "z").withColumns({"tr": F.floor(F.col("kr") / reach), "tc": F.floor(F.col("kc") / reach)})
        d2 = (F.col("r") - F.col("kr")) * (F.col("r") - F.col("kr")) + (F.col("c") - F.col("kc")) * (F.col("c") - F.col("kc"))
        found = near.join(cells, ["tr", "tc"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach).groupBy("r", "c").agg(F.min_by("z", F.struct("d2", "kr", "kc")).alias("z"))
        found = kept(found)
        filled = filled.unionByName(found)
        open_cells = kept(open_cells.join(found, ["r", "c"], "left_anti"))
        reach *= 2
    return filled.unionByName(open_cells.withColumn("z", F.lit(None).cast(known.schema["z"].dataType)))


def slope_aspect(points: DataFrame, dem: DataFrame, grid: Grid, k: int = 5) -> DataFrame:
    """points (id, x, y) with the compass bearing downhill of the mean slope in the square of 2k + 1 cells round them.

    Points whose square isn't whole, or is flat, are left out. The mean of differences
    along a line hangs on two cells at each of its ends alone.
    """
    n = 2 * k + 1
    at = points.select("id", F.floor((F.col("y") - grid.y0) / grid.e).cast("int").alias("pr"), F.floor((F.col("x") - grid.x0) / grid.a).cast("int").alias("pc"))
    span = F.sequence(F.lit(-k), F.lit(k))
    square = at.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).withColumns({"r": F.col("pr") + F.col("dr"), "c": F.col("pc") + F.col("dc")})
    weight = lambda d: F.when(d == -k, -1.5).when(d == 1 - k, 0.5).when(d == k - 1, -0.5).when(d == k, 1.5).otherwise(0.0)
    cells = square.join(dem.where("z IS NOT NULL"), ["r", "c"])
    sums = cells.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("z") * weight(F.col("dr"))).alias("gr"), F.sum(F.col("z") * weight(F.col("dc"))).alias("gc"))
    gx, gy = F.col("gc") / (n * n * grid.a), F.col("gr") / (n * n * grid.e)
    return sums.where((F.col("n") == n * n) & (gx * gx + gy * gy > 1e-18)).select("id", F.pmod(F.degrees(F.atan2(-gx, -gy)), F.lit(360.0)).alias("aspect"), F.sqrt(gx * gx + gy * gy).alias("slope"))


def round_blobs(labels: DataFrame, smallest: float, cell: float = 1.0) -> DataFrame:
    """Of labelled cells (label, r, c): each blob's size, centre and the radius of a disc of its area, if that is large enough."""
    b = labels.groupBy("label").agg(F.count("*").alias("n"), F.avg("r").alias("r"), F.avg("c").alias("c"))
    return b.withColumn("radius", F.sqrt(F.col("n") * cell * cell / F.lit(3.141592653589793))).where(F.col("radius") >= smallest)


def describe(dem: DataFrame, grid: Grid) -> DataFrame:
    """One row about a grid: cells, cells with data, heights, and its bounds."""
    d = dem.agg(F.count("*").alias("cells"), F.count("z").alias("valid"), F.min("z").alias("lowest"), F.max("z").alias("highest"), F.avg("z").alias("mean"), (F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return d.withColumns({"left": F.lit(grid.x0), "top": F.lit(grid.y0), "right": F.lit(grid.x0) + F.col("width") * grid.a, "bottom": F.lit(grid.y0) + F.col("height") * grid.e})


def is_seen(value: Column, nodata: float) -> Column:
    """Whether a baseline raster's value marks a cell: a finite number that isn't the sentinel."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")) & (v != nodata), F.lit(False))


def agreement_class(a: Column, b: Column, valid: Column) -> Column:
    """How two masks agree at a cell."""
    return F.when(~valid, "outside").when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither")


def step_of(values: DataFrame, column: str) -> DataFrame:
    """One row step: the least difference of distinct values, 1 if there is none."""
    v = values.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    parts = v.repartitionByRange("v").select("v", F.spark_partition_id().alias("p"))
    inside = parts.withColumn("d", F.col("v") - F.lag("v").over(W.partitionBy("p").orderBy("v")))
    edges = parts.groupBy("p").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("d", F.col("lo") - F.lag("hi").over(W.orderBy("lo")))
    return inside.select("d").unionByName(edges.select("d")).agg(F.coalesce(F.min("d"), F.lit(1.0)).cast("double").alias("step"))


def voxelize(points: DataFrame, voxel: float, zstep: float, order: str) -> DataFrame:
    """(r, c, l, value): points (x, y, z, value) in cells counted from the least coordinates, halves to even; of several in a cell the last by order stays."""
    low = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("z").alias("z0"))
    p = points.join(F.broadcast(low))
    at = lambda v, v0, step: F.rint((F.col(v) - F.col(v0)) / step).cast("int")
    return p.select(at("y", "y0", voxel).alias("r"), at("x", "x0", voxel).alias("c"), at("z", "z0", zstep).alias("l"), order, "value").groupBy("r", "c", "l").agg(F.max_by("value", order).alias("value"))


def to_world(vertices: DataFrame, four: DataFrame, grid: Grid, z0: float, zstep: float) -> DataFrame:
    """Voxel vertices (r, c, l) as x, y, z: levels stand on the ground under them, which goes on level beyond its edge."""
    at = vertices.withColumns({"x": grid.x(F.col("c")), "y": grid.y(F.col("r"))})
    inside = at.withColumns({"sx": F.least(F.greatest(F.col("x"), F.lit(grid.x0 + grid.a * 0.5)), F.lit(grid.x0 + grid.a * (grid.w - 0.5001))), "sy": F.greatest(F.least(F.col("y"), F.lit(grid.y0 + grid.e * 0.5)), F.lit(grid.y0 + grid.e * (grid.h - 0.5001)))})
    return bilinear(inside, four, grid, "sx", "sy", "ground").withColumn("z", F.col("ground") + z0 + F.col("l") * zstep).drop("sx", "sy")


def terrain_faces(dem: DataFrame, step: int) -> DataFrame:
    """(a, b, d): triangles over every step-th cell, by vertex numbers r * width + c of the coarse grid; two for each square whose corners are there."""
    coarse = dem.where(f"r % {step} = 0 AND c % {step} = 0").select((F.col("r") / step).cast("long").alias("r"), (F.col("c") / step).cast("long").alias("c"))
    width = coarse.agg((F.max("c") + 1).alias("w"))
    corner = F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in (0, 1) for j in (0, 1)))
    squares = coarse.withColumn("s", F.explode(corner)).groupBy((F.col("r") - F.col("s.dr")).alias("r"), (F.col("c") - F.col("s.dc")).alias("c")).agg(F.count("*").alias("n")).where("n = 4").join(F.broadcast(width))
    v = lambda i, j: (F.col("r") + i) * F.col("w") + F.col("c") + j
    both = F.array(F.struct(v(0, 0).alias("a"), v(1, 0).alias("b"), v(0, 1).alias("d")), F.struct(v(0, 1).alias("a"), v(1, 0).alias("b"), v(1, 1).alias("d")))
    return squares.select(F.explode(both).alias("t")).select("t.*")
