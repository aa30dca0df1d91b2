"""Queries of the raster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import grid as g
from vantage.operators import labels as lb
from vantage.operators import raster as rs
from vantage.session import table

from .scenes import DEM_SQL, GRID, dem, eyes, rectangles

FINE = g.Grid(0.0, 0.0, 0.75, -0.75, 80, 80)


def polygons(spark, sf_dir):
    """A five-sided footprint for each part: edges id, e, x0, y0, x1, y1, height."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 11 % 56 + 1.37).cast("double"), (-(k * 17 % 56) - 6.41).cast("double")
    w, h = 2.13 + s % 4, 1.71 + s % 3
    ring = [(x, y), (x + w, y + 0.29), (x + w * 1.25, y + h), (x + w / 2, y + h * 1.5), (x - 0.31, y + h)]
    sides = F.array(*(F.struct(F.lit(i).alias("e"), a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))))
    return table(spark, sf_dir, "part").select(k.alias("id"), (s % 7 + 1).cast("double").alias("height"), F.explode(sides).alias("s")).select("id", "height", "s.*")


def polygon_burn(spark, sf_dir):
    """The tallest five-sided footprint over each cell."""
    return rs.burn_polygons(polygons(spark, sf_dir), GRID).select("r", "c", "id", F.col("height").cast("long").alias("height"))


def un_extruded(spark, sf_dir):
    """Raised ground put back to bare ground under the footprints of odd parts."""
    heights = dem(spark, sf_dir)
    top = rs.burn_polygons(polygons(spark, sf_dir), GRID).select("r", "c", "height")
    raised = heights.join(top, ["r", "c"], "left").select("r", "c", (F.col("z") + F.coalesce("height", F.lit(0.0))).alias("z"))
    odd = rs.burn_polygons(polygons(spark, sf_dir).where("id % 2 = 1"), GRID)
    return rs.un_extrude(raised, odd, heights).select("r", "c", F.col("z").cast("long").alias("z"))


def core_window(spark, sf_dir):
    """Cells with data in the window of all parts' boxes with a margin of two, and how many."""
    window = rs.core_window(rectangles(spark, sf_dir).where("id % 5 = 0 AND x0 > 8"), GRID, 2.0)
    inside = rs.crop_to(dem(spark, sf_dir), window, nodata=3.0)
    return inside.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("z").alias("n"))


def observer_windows(spark, sf_dir):
    """The square of cells round each observer, and how many cells with data it has."""
    heights = dem(spark, sf_dir)
    w = rs.observer_window(eyes(spark, sf_dir, heights), GRID, 3.5)
    cells = w.select("eye", "r0", "r1", "c0", "c1", F.explode(F.sequence("r0", F.least("r1", F.lit(63)))).alias("r")).withColumn("c", F.explode(F.sequence("c0", F.least("c1", F.lit(63)))))
    return cells.join(heights.where("z IS NOT NULL"), ["r", "c"]).groupBy("eye", "r0", "r1", "c0", "c1").agg(F.count("*").alias("n"))


def resampled(spark, sf_dir):
    """The surface on a grid of three quarter cells, in ten thousandths."""
    out = rs.resample(g.corners(dem(spark, sf_dir)), GRID, FINE, spark)
    return out.where("z IS NOT NULL").select("r", "c", F.rint(F.col("z") * 10000).cast("long").alias("z_e4"))


def surface_difference(spark, sf_dir):
    """Raised less bare ground, on and off the footprints."""
    heights = dem(spark, sf_dir)
    top = rs.burn_polygons(polygons(spark, sf_dir), GRID)
    raised = heights.join(top, ["r", "c"], "left").select("r", "c", (F.col("z") + F.coalesce("height", F.lit(0.0)) + F.col("c") % 3).alias("z"))
    s = rs.difference_stats(raised, heights, top)
    return s.select("on", "n", *(F.rint(F.col(x) * 1000).cast("long").alias(x) for x in ("median", "p5", "p95", "signal")))


def nearest_filled(spark, sf_dir):
    """The grid with its holes filled, holes made wider for it."""
    d = dem(spark, sf_dir)
    holes = F.when((F.col("r") * 5 + F.col("c") * 3) % 11 < 3, None).otherwise(F.when((F.col("r") < 40) | (F.col("c") > 12), F.col("z")))
    return rs.nearest_fill(d.select("r", "c", holes.alias("z"))).select("r", "c", F.col("z").cast("long").alias("z"))


def slope_aspects(spark, sf_dir):
    """Bearing downhill about each supplier's place, in hundredths of a degree."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 62 + 1.5).cast("double").alias("x"), (-(F.col("s_suppkey") * 13 % 62 + 1.5)).cast("double").alias("y"))
    filled = dem(spark, sf_dir).select("r", "c", F.coalesce("z", F.lit(4.0)).alias("z"))
    return rs.slope_aspect(s, filled, GRID, 2).select("id", F.rint(F.col("aspect") * 100).cast("long").alias("aspect_e2"), F.rint(F.col("slope") * 1e6).cast("long").alias("slope_e6"))


def dome_blobs(spark, sf_dir):
    """Blobs of high cells that are as large as a disc of radius 0.9: centre and radius in thousandths."""
    cells = dem(spark, sf_dir).where("z >= 7").select("r", "c")
    b = rs.round_blobs(lb.label_cells(cells, 64), 0.9)
    whole = lambda x: F.rint(F.col(x) * 1000).cast("long").alias(x)
    return b.select("label", "n", whole("r"), whole("c"), whole("radius"))


def raster_summary(spark, sf_dir):
    """What the grid holds."""
    d = rs.describe(dem(spark, sf_dir), GRID)
    return d.select("cells", "valid", *(F.col(x).cast("long").alias(x) for x in ("lowest", "highest", "height", "width", "left", "top", "right", "bottom")), F.rint(F.col("mean") * 1e6).cast("long").alias("mean_e6"))


def agreement_overlay(spark, sf_dir):
    """How two thresholds of the grid agree, cell class by row band."""
    d = dem(spark, sf_dir).withColumn("b", F.when(F.col("c") % 7 == 0, F.lit(float("nan"))).when(F.col("c") % 5 == 0, -9999.0).otherwise(F.col("z")))
    kind = rs.agreement_class(F.coalesce(F.col("z") > 4, F.lit(False)), rs.is_seen(F.col("b"), -9999.0), F.col("r") > 3)
    return d.groupBy(F.floor(F.col("r") / 8).cast("int").alias("band"), kind.alias("kind")).agg(F.count("*").alias("n"))


def voxel_bins(spark, sf_dir):
    """Orders' points in cells of 2 x 2 x 1.5, the last order of each."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(k.alias("seq"), (k * 7 % 199 * 0.5).cast("double").alias("x"), (k * 13 % 97 * 0.5).cast("double").alias("y"), (k % 9 * 0.5).cast("double").alias("z"), F.col("o_custkey").alias("value"))
    return rs.voxelize(p, 2.0, 1.5, "seq")


def inferred_step(spark, sf_dir):
    """The least difference of part prices, in millionths."""
    return rs.step_of(table(spark, sf_dir, "part").select((F.col("p_size") * 3 + F.col("p_partkey") % 2 * 1.5).alias("v")), "v").select(F.rint(F.col("step") * 1e6).cast("long").alias("step_e6"))


def warped_vertices(spark, sf_dir):
    """Where voxel corners of every order stand in the world, in ten thousandths."""
    k = F.col("o_orderkey")
    v = table(spark, sf_dir, "orders").select("o_orderkey", (k * 7 % 61 + 0.5).cast("double").alias("r"), (k * 13 % 61 + 0.25).cast("double").alias("c"), (k % 5).cast("double").alias("l"))
    out = rs.to_world(v, g.corners(dem(spark, sf_dir)), GRID, 0.5, 1.5)
    return out.where("z IS NOT NULL").select("o_orderkey", F.rint(F.col("x") * 100).cast("long").alias("x_e2"), F.rint(F.col("y") * 100).cast("long").alias("y_e2"), F.rint(F.col("z") * 10000).cast("long").alias("z_e4"))


def terrain_mesh(spark, sf_dir):
    """Triangles of the grid's every second cell with data."""
    return rs.terrain_faces(dem(spark, sf_dir).where("z IS NOT NULL"), 2)


QUERIES = {f.__name__: f for f in (polygon_burn, un_extruded, core_window, observer_windows, resampled, surface_difference, nearest_filled, slope_aspects, dome_blobs, raster_summary, agreement_overlay, voxel_bins, inferred_step, warped_vertices, terrain_mesh)}

POLYGON_SQL = """corners AS (
  SELECT p_partkey AS id, CAST(p_size % 7 + 1 AS BIGINT) AS height, p_partkey * 11 % 56 + 1.37::DOUBLE AS x, -(p_partkey * 17 % 56) - 6.41::DOUBLE AS y, 2.13::DOUBLE + p_size % 4 AS w, 1.71::DOUBLE + p_size % 3 AS h FROM part
), rings AS (
  SELECT id, height, [x, x + w, x + w * 1.25::DOUBLE, x + w / 2, x - 0.31::DOUBLE] AS xs, [y, y + 0.29::DOUBLE, y + h, y + h * 1.5::DOUBLE, y + h] AS ys FROM corners
), sides AS (
  SELECT id, height, xs[e] AS x0, ys[e] AS y0, xs[e % 5 + 1] AS x1, ys[e % 5 + 1] AS y1 FROM rings, range(1, 6) t(e)
), cells AS (SELECT r, c, c + 0.5::DOUBLE AS px, -(r + 0.5::DOUBLE) AS py FROM range(64) a(r), range(64) b(c)
), inside AS (
  SELECT id, height, r, c FROM sides JOIN cells ON (y0 > py) <> (y1 > py) AND px < x0 + (py - y0) * (x1 - x0) / (y1 - y0) GROUP BY ALL HAVING count(*) % 2 = 1
), tops AS (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, arg_max(id, height * 1000000000 - id) AS id, max(height) AS height FROM inside GROUP BY 1, 2)"""
BLOBS_SQL = f"""RECURSIVE {DEM_SQL}, k AS (SELECT r, c, r * 64 + c AS i FROM dem WHERE z >= 7), reach AS (
  SELECT i AS root, r, c FROM k UNION SELECT root, k.r, k.c FROM reach JOIN k ON abs(k.r - reach.r) + abs(k.c - reach.c) = 1), lab AS (SELECT r, c, min(root) AS label FROM reach GROUP BY r, c)"""
BILINEAR = "((z00 * (1 - (cf - f.c)) + z01 * (cf - f.c)) * (1 - (rf - f.r)) + (z10 * (1 - (cf - f.c)) + z11 * (cf - f.c)) * (rf - f.r))"
ORACLES = {
    "polygon_burn": f"WITH {POLYGON_SQL} SELECT r, c, id, height FROM tops",
    "un_extruded": f"""WITH {DEM_SQL}, {POLYGON_SQL}, odd AS (SELECT DISTINCT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, true AS hit FROM inside WHERE id % 2 = 1)
      SELECT d.r, d.c, CAST(CASE WHEN hit THEN z ELSE z + coalesce(t.height, 0) END AS BIGINT) AS z FROM dem d LEFT JOIN tops t USING (r, c) LEFT JOIN odd USING (r, c)""",
    "core_window": f"""WITH {DEM_SQL}, w AS (SELECT min(x0) - 2 AS l, max(x1) + 2 AS x, min(y0) - 2 AS b, max(y1) + 2 AS t FROM rects WHERE id % 5 = 0 AND x0 > 8)
      SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) FILTER (z <> 3) AS n FROM dem, w WHERE r BETWEEN greatest(0, floor(-t)) AND greatest(0, floor(-b)) AND c BETWEEN greatest(0, floor(l)) AND greatest(0, floor(x))""",
    "observer_windows": f"""WITH {DEM_SQL}, w AS (SELECT eye, CAST(greatest(0, floor(-ey) - 4) AS INTEGER) AS r0, CAST(floor(-ey) + 4 AS INTEGER) AS r1, CAST(greatest(0, floor(ex) - 4) AS INTEGER) AS c0, CAST(floor(ex) + 4 AS INTEGER) AS c1 FROM eyes)
      SELECT eye, r0, r1, c0, c1, count(*) AS n FROM w JOIN dem ON z IS NOT NULL AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY ALL""",
    "resampled": f"""WITH {DEM_SQL}, p AS (SELECT CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c, (i + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE AS rf, (j + 0.5::DOUBLE) * 0.75::DOUBLE - 0.5::DOUBLE AS cf FROM range(80) a(i), range(80) b(j))
      SELECT p.r, p.c, CAST(round_even({BILINEAR} * 10000, 0) AS BIGINT) AS z_e4 FROM p JOIN four f ON f.r = CAST(floor(rf) AS INTEGER) AND f.c = CAST(floor(cf) AS INTEGER)""",
    "surface_difference": f"""WITH {DEM_SQL}, {POLYGON_SQL}, d AS (SELECT t.id IS NOT NULL AS "on", CAST(coalesce(height, 0) + d.c % 3 AS DOUBLE) AS d FROM dem d LEFT JOIN tops t USING (r, c) WHERE z IS NOT NULL),
      s AS (SELECT "on", count(*) AS n, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.05) AS a, quantile_cont(d, 0.95) AS b FROM d GROUP BY 1)
      SELECT "on", n, CAST(round_even(m * 1000, 0) AS BIGINT) AS median, CAST(round_even(a * 1000, 0) AS BIGINT) AS p5, CAST(round_even(b * 1000, 0) AS BIGINT) AS p95,
        CAST(round_even((m - coalesce((SELECT m FROM s WHERE NOT "on"), 0)) * 1000, 0) AS BIGINT) AS signal FROM s""",
    "nearest_filled": f"""WITH {DEM_SQL}, h AS (SELECT r, c, CASE WHEN (r * 5 + c * 3) % 11 < 3 THEN NULL WHEN r < 40 OR c > 12 THEN z END AS z FROM dem), k AS (SELECT * FROM h WHERE z IS NOT NULL),
      f AS (SELECT h.r, h.c, k.z FROM h JOIN k ON h.z IS NULL QUALIFY row_number() OVER (PARTITION BY h.r, h.c ORDER BY (h.r - k.r) * (h.r - k.r) + (h.c - k.c) * (h.c - k.c), k.r, k.c) = 1)
      SELECT r, c, CAST(z AS BIGINT) AS z FROM k UNION ALL SELECT r, c, CAST(z AS BIGINT) FROM f""",
    "slope_aspects": f"""WITH {DEM_SQL}, f AS (SELECT r, c, coalesce(z, 4) AS z FROM dem), s AS (SELECT s_suppkey AS id, s_suppkey * 13 % 62 + 1 AS pr, s_suppkey * 7 % 62 + 1 AS pc FROM supplier),
      n AS (SELECT id, r, c, r - pr AS dr, c - pc AS dc, z,
          (CASE WHEN r - pr = -2 THEN lead(z) OVER d - z WHEN r - pr = 2 THEN z - lag(z) OVER d ELSE (lead(z) OVER d - lag(z) OVER d) / 2 END) AS gr,
          (CASE WHEN c - pc = -2 THEN lead(z) OVER a - z WHEN c - pc = 2 THEN z - lag(z) OVER a ELSE (lead(z) OVER a - lag(z) OVER a) / 2 END) AS gc
        FROM s JOIN f ON r BETWEEN pr - 2 AND pr + 2 AND c BETWEEN pc - 2 AND pc + 2 WINDOW d AS (PARTITION BY id, c ORDER BY r), a AS (PARTITION BY id, r ORDER BY c)),
      m AS (SELECT id, count(*) AS n, avg(gc) AS gx, -avg(gr) AS gy FROM n GROUP BY id)
      SELECT id, CAST(round_even(((degrees(atan2(-gx, -gy)) % 360) + 360) % 360 * 100, 0) AS BIGINT) AS aspect_e2, CAST(round_even(sqrt(gx * gx + gy * gy) * 1e6, 0) AS BIGINT) AS slope_e6 FROM m WHERE n = 25 AND gx * gx + gy * gy > 1e-18""",
    "dome_blobs": f"""WITH {BLOBS_SQL}, b AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS n, avg(r) AS r, avg(c) AS c, sqrt(count(*) / pi()) AS radius FROM lab GROUP BY 1)
      SELECT label, n, CAST(round_even(r * 1000, 0) AS BIGINT) AS r, CAST(round_even(c * 1000, 0) AS BIGINT) AS c, CAST(round_even(radius * 1000, 0) AS BIGINT) AS radius FROM b WHERE radius >= 0.9""",
    "raster_summary": f"""WITH {DEM_SQL} SELECT count(*) AS cells, count(z) AS valid, CAST(min(z) AS BIGINT) AS lowest, CAST(max(z) AS BIGINT) AS highest, CAST(max(r) + 1 AS BIGINT) AS height, CAST(max(c) + 1 AS BIGINT) AS width,
      0::BIGINT AS "left", 0::BIGINT AS top, CAST(max(c) + 1 AS BIGINT) AS "right", CAST(-(max(r) + 1) AS BIGINT) AS bottom, CAST(round_even(avg(z) * 1e6, 0) AS BIGINT) AS mean_e6 FROM dem""",
    "agreement_overlay": f"""WITH {DEM_SQL}, m AS (SELECT r, coalesce(z > 4, false) AS a, c % 7 <> 0 AND c % 5 <> 0 AND z IS NOT NULL AS b FROM dem)
      SELECT CAST(r // 8 AS INTEGER) AS band, CASE WHEN r <= 3 THEN 'outside' WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'neither' END AS kind, count(*) AS n FROM m GROUP BY 1, 2""",
    "voxel_bins": """WITH p AS (SELECT o_orderkey AS k, o_custkey, o_orderkey * 7 % 199 * 0.5::DOUBLE AS x, o_orderkey * 13 % 97 * 0.5::DOUBLE AS y, o_orderkey % 9 * 0.5::DOUBLE AS z FROM orders), m AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM p)
      SELECT CAST(round_even((y - y0) / 2, 0) AS INTEGER) AS r, CAST(round_even((x - x0) / 2, 0) AS INTEGER) AS c, CAST(round_even((z - z0) / 1.5::DOUBLE, 0) AS INTEGER) AS l, arg_max(o_custkey, k) AS value FROM p, m GROUP BY 1, 2, 3""",
    "inferred_step": """WITH v AS (SELECT DISTINCT p_size * 3 + p_partkey % 2 * 1.5::DOUBLE AS v FROM part), d AS (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM v) SELECT CAST(round_even(coalesce(min(d), 1) * 1e6, 0) AS BIGINT) AS step_e6 FROM d""",
    "warped_vertices": f"""WITH {DEM_SQL}, v AS (SELECT o_orderkey, o_orderkey * 7 % 61 + 0.5::DOUBLE AS rf, o_orderkey * 13 % 61 + 0.25::DOUBLE AS cf, o_orderkey % 5 AS l FROM orders)
      SELECT o_orderkey, CAST(round_even((cf + 0.5::DOUBLE) * 100, 0) AS BIGINT) AS x_e2, CAST(round_even(-(rf + 0.5::DOUBLE) * 100, 0) AS BIGINT) AS y_e2, CAST(round_even(({BILINEAR} + 0.5::DOUBLE + l * 1.5::DOUBLE) * 10000, 0) AS BIGINT) AS z_e4
      FROM v JOIN four f ON f.r = CAST(floor(rf) AS INTEGER) AND f.c = CAST(floor(cf) AS INTEGER)""",
    "terrain_mesh": f"""WITH {DEM_SQL}, k AS (SELECT r // 2 AS r, c // 2 AS c FROM dem WHERE z IS NOT NULL AND r % 2 = 0 AND c % 2 = 0), w AS (SELECT max(c) + 1 AS w FROM k),
      q AS (SELECT a.r, a.c, w FROM k a JOIN k b ON b.r = a.r AND b.c = a.c + 1 JOIN k d ON d.r = a.r + 1 AND d.c = a.c JOIN k e ON e.r = a.r + 1 AND e.c = a.c + 1, w)
      SELECT CAST(r * w + c AS BIGINT) AS a, CAST((r + 1) * w + c AS BIGINT) AS b, CAST(r * w + c + 1 AS BIGINT) AS d FROM q UNION ALL SELECT CAST(r * w + c + 1 AS BIGINT), CAST((r + 1) * w + c AS BIGINT), CAST((r + 1) * w + c + 1 AS BIGINT) FROM q""",
}
