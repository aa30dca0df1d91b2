"""Queries of drawings and stored grids: curves as chords, thickness of scanned plans, tiles written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vantage.operators import curves as cv
from vantage.operators import plates as pl
from vantage.operators.scratch import kept, shared_folder
from vantage.session import table
from vantage.sources import tilestore as ts
from vantage.sources.readers import dxf_entities

from .scenes import WIDE_SQL, wide_dem, wide_grid

TOL = 5.0
SIDE = 128
PPM = 20


def _drawing(spark, sf_dir):
    """The lines of a drawing for each part: a ring with two bulged sides, an arc, a circle, a line, and an entity that doesn't count."""
    k, s = F.col("p_partkey"), F.col("p_size")
    w, h = (k % 7 + 4) * 1000, (s % 5 + 3) * 1000
    b = [(k % 4 + 1) * 0.2, F.lit(0.0), -(s % 3) * 0.25, F.lit(0.0)]
    zero = F.lit(0)
    ring = [t for (x, y), n in zip(((zero, zero), (w, zero), (w, h), (zero, h)), b) for t in ((10, x), (20, y), (42, n))]
    tags = [(0, F.lit("SECTION")), (2, F.lit("ENTITIES")), (0, F.lit("LWPOLYLINE")), (8, F.lit("LW1")), (70, F.lit(1)), *ring]
    tags += [(0, F.lit("ARC")), (8, F.lit("ABOVE")), (10, w), (20, h), (40, (k % 6 + 1) * 500), (50, k * 37 % 360), (51, (k * 37 + s * 11) % 360)]
    tags += [(0, F.lit("CIRCLE")), (10, zero), (20, h), (40, (s % 9 + 1) * 250), (0, F.lit("HATCH")), (10, zero)]
    tags += [(0, F.lit("LINE")), (8, F.lit("LW2")), (10, zero), (20, zero), (11, w), (21, h), (0, F.lit("ENDSEC"))]
    text = F.array(*(c.cast("string") for code, v in tags for c in (F.lit(code), v)))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("file"), F.posexplode(text).alias("line_no", "line"))


def drawn_curves(spark, sf_dir):
    """Each drawing's entities as chords, turned, scaled to metres and shifted: how many, how long, and what area a ring or circle holds."""
    segs = cv.chords(cv.pieces(dxf_entities(_drawing(spark, sf_dir)), ["file", "entity"]), TOL)
    k = F.col("file").cast("long")
    a = F.radians((k % 360).cast("double"))
    c, s = F.cos(a) * 0.001, F.sin(a) * 0.001
    segs = cv.moved(segs, [c, s, -s, c, (k % 100).cast("double"), (k % 13).cast("double")])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    sums = segs.groupBy("file", "kind", "layer").agg(F.count("*").alias("n"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("l"), (F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    closed = F.col("kind").isin("LWPOLYLINE", "CIRCLE")
    return sums.select(k.alias("p_partkey"), "kind", "layer", "n", F.rint(F.col("l") * 1000).cast("long").alias("length_mm"), F.when(closed, F.rint(F.col("area") * 1000).cast("long")).alias("area_e3"))


def _plans(spark, sf_dir):
    """A scanned plan for each supplier: its window, and the ink of walls round one room, hatched, with a doorway below; every seventh is traced too small, every ninth is a few dots."""
    k = F.col("s_suppkey")
    sizes = table(spark, sf_dir, "supplier").select(k, (k % 11 + 2).alias("t"), (k % 17 + 60).alias("rh"), (k % 23 + 62).alias("rw"))
    h, w = F.col("rh") + 2 * F.col("t"), F.col("rw") + 2 * F.col("t")
    sizes = sizes.withColumns({"h": h, "w": w})
    traced = F.greatest(F.col("h"), F.col("w")) / PPM / F.when(k % 7 == 0, 1.5).otherwise(1.0)
    plates = sizes.select(k, F.lit(0).alias("r0"), (F.col("h") + 50).alias("r1"), F.lit(0).alias("c0"), (F.col("w") + 10).alias("c1"), F.lit(float(PPM)).alias("ppm"), traced.alias("traced"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    y, x, t = F.col("y"), F.col("x"), F.col("t")
    off = F.least(y, x, F.col("h") - 1 - y, F.col("w") - 1 - x)
    door = (y >= F.col("h") - t) & (x >= F.col("w") / 2) & (x < F.col("w") / 2 + 8)
    dots = (k % 9 > 0) | ((x + y) % 40 == 0)
    cells = sizes.withColumn("y", span("h")).withColumn("x", span("w")).where((off < t) & ((off == 0) | (off == t - 1) | ((x + y) % 3 == 0)) & ~door & dots)
    return cells.select(k, (y + 5).alias("r"), (x + 5).alias("c")), plates


def plan_thickness(spark, sf_dir):
    """Thickness of the walls of each scanned plan, in millimetres; null where its extent is off or readings are few."""
    ink, plates = _plans(spark, sf_dir)
    out = pl.plate_thickness(kept(ink), plates, ["s_suppkey"])
    return out.select("s_suppkey", *(F.rint(F.col(c) * 1000).cast("long").alias(f"{c}_mm") for c in ("thickness", "iqr")), "n", F.rint(F.col("ratio") * 1e6).cast("long").alias("ratio_e6"))


def stored_tiles(spark, sf_dir):
    """The wide scene's heights written as tiles; of a window read back, cells, those without data and the heights' sum by tile."""
    grid = wide_grid(spark, sf_dir)
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    ts.write_tiles(wide_dem(spark, sf_dir, grid), grid, path, SIDE)
    n = grid.w
    back = ts.read_tiles(spark, path, (n // 8, n - 1 - n // 5, n // 6, n - 1))
    by = lambda k: F.floor(F.col(k) / SIDE).cast("int")
    return back.groupBy(by("r").alias("tr"), by("c").alias("tc")).agg(F.count("*").alias("n"), F.count_if(F.col("z").isNull()).alias("n_null"), F.sum("z").cast("long").alias("total"))


QUERIES = {f.__name__: f for f in (drawn_curves, plan_thickness, stored_tiles)}
ORACLES = {
    # arcs by the closed formulas of regular chords
    "drawn_curves": f"""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 7 * 1000 + 4000.0::DOUBLE AS w, p_size % 5 * 1000 + 3000.0::DOUBLE AS h FROM part),
      arcs AS (SELECT k, 'LWPOLYLINE' AS kind, 'LW1' AS layer, 4 * atan(b) AS sweep, w / 2 / sin(2 * atan(b)) AS r FROM (SELECT *, (k % 4 + 1) * 0.2::DOUBLE AS b FROM p)
        UNION ALL SELECT k, 'LWPOLYLINE', 'LW1', -4 * atan(b), w / 2 / sin(2 * atan(b)) FROM (SELECT *, s % 3 * 0.25::DOUBLE AS b FROM p) WHERE b > 0
        UNION ALL SELECT k, 'ARC', 'ABOVE', radians(CASE WHEN s * 11 % 360 = 0 THEN 360 ELSE s * 11 % 360 END / 2.0::DOUBLE), (k % 6 + 1) * 500.0::DOUBLE FROM p, range(2)
        UNION ALL SELECT k, 'CIRCLE', '0', pi(), (s % 9 + 1) * 250.0::DOUBLE FROM p, range(2)),
      cut AS (SELECT *, CAST(greatest(1, ceil(abs(sweep) / (2 * acos(greatest(0.0, 1 - {TOL}::DOUBLE / r))) - 1e-12)) AS BIGINT) AS n FROM arcs),
      parts AS (SELECT k, kind, layer, n, n * 2 * r * sin(abs(sweep) / (2 * n)) AS l, r * r / 2 * (n * sin(sweep / n) - CASE kind WHEN 'LWPOLYLINE' THEN sin(sweep) ELSE 0 END) AS area FROM cut
        UNION ALL SELECT k, 'LWPOLYLINE', 'LW1', 2 + (s % 3 = 0)::INT, 2 * h + CASE WHEN s % 3 = 0 THEN w ELSE 0 END, w * h FROM p UNION ALL SELECT k, 'LINE', 'LW2', 1, sqrt(w * w + h * h), 0 FROM p)
      SELECT k AS p_partkey, kind, layer, CAST(sum(n) AS BIGINT) AS n, CAST(round_even(sum(l), 0) AS BIGINT) AS length_mm, CASE WHEN kind IN ('LWPOLYLINE', 'CIRCLE') THEN CAST(round_even(sum(area) / 1000, 0) AS BIGINT) END AS area_e3 FROM parts GROUP BY k, kind, layer""",
    # every line of cells as a string of ink and white
    "plan_thickness": f"""WITH z AS (SELECT *, rh + 2 * t AS h, rw + 2 * t AS w FROM (SELECT s_suppkey AS k, s_suppkey % 11 + 2 AS t, s_suppkey % 17 + 60 AS rh, s_suppkey % 23 + 62 AS rw FROM supplier)),
      dots AS (SELECT k, h + 50 AS hh, w + 10 AS ww, y, x, t, h, w, least(y - 5, x - 5, h - 1 - (y - 5), w - 1 - (x - 5)) AS off_ FROM z, (SELECT unnest(range(200)) AS y), (SELECT unnest(range(200)) AS x) WHERE y < h + 50 AND x < w + 10),
      page AS (SELECT k, hh, ww, y, x, off_ >= 0 AND off_ < t AND (off_ = 0 OR off_ = t - 1 OR (x + y - 10) % 3 = 0) AND NOT (y - 5 >= h - t AND x - 5 >= w / 2 AND x - 5 < w / 2 + 8) AND (k % 9 > 0 OR (x + y - 10) % 40 = 0) AS ink FROM dots),
      lines AS (SELECT k, string_agg(CASE WHEN ink THEN '1' ELSE '0' END, '' ORDER BY x) AS t FROM page WHERE y >= floor(hh * 0.3::DOUBLE) AND y < floor(hh * 0.7::DOUBLE) AND (y - floor(hh * 0.3::DOUBLE)) % greatest(hh // 60, 1) = 0 GROUP BY k, y
        UNION ALL SELECT k, string_agg(CASE WHEN ink THEN '1' ELSE '0' END, '' ORDER BY y) FROM page WHERE x >= floor(ww * 0.3::DOUBLE) AND x < floor(ww * 0.7::DOUBLE) AND (x - floor(ww * 0.3::DOUBLE)) % greatest(ww // 60, 1) = 0 GROUP BY k, x),
      ways AS (SELECT k, ltrim(t, '0') AS t FROM lines UNION ALL SELECT k, ltrim(reverse(t), '0') FROM lines),
      v AS (SELECT k, (strpos(t, repeat('0', {PPM})) - 1) / {PPM}::DOUBLE AS v FROM ways WHERE strpos(t, repeat('0', {PPM})) > 0),
      m AS (SELECT k, count(*) AS n, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS i FROM v WHERE v > 0.05 AND v < 1.5 GROUP BY k),
      e AS (SELECT k, count(*) AS n, greatest(max(x) - min(x), max(y) - min(y)) / {PPM}::DOUBLE AS d FROM page WHERE ink AND y < hh * 0.8::DOUBLE GROUP BY k),
      o AS (SELECT z.k, m.n, m, i, CASE WHEN e.n >= 100 THEN d / (greatest(h, w) / {PPM}::DOUBLE / CASE WHEN z.k % 7 = 0 THEN 1.5::DOUBLE ELSE 1 END) END AS ratio FROM z LEFT JOIN m ON m.k = z.k LEFT JOIN e ON e.k = z.k),
      f AS (SELECT *, n >= 8 AND abs(ratio - 1) <= 0.25 AS ok FROM o)
      SELECT k AS s_suppkey, CASE WHEN ok THEN CAST(round_even(m * 1000, 0) AS BIGINT) END AS thickness_mm, CASE WHEN ok THEN CAST(round_even(i * 1000, 0) AS BIGINT) END AS iqr_mm, CASE WHEN ok THEN n END AS n, CAST(round_even(ratio * 1e6, 0) AS BIGINT) AS ratio_e6 FROM f""",
    "stored_tiles": f"""WITH {WIDE_SQL} SELECT CAST(r // {SIDE} AS INTEGER) AS tr, CAST(c // {SIDE} AS INTEGER) AS tc, count(*) AS n, count(*) FILTER (z IS NULL) AS n_null, CAST(sum(z) AS BIGINT) AS total FROM wide_dem, side
      WHERE r BETWEEN n // 8 AND n - 1 - n // 5 AND c BETWEEN n // 6 AND n - 1 GROUP BY 1, 2""",
}
