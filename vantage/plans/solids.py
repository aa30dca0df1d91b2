"""Queries of fitted planes and maps, plans matched to walls, shells with openings, and points inside rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import mesh as ms
from vantage.operators import solids as so
from vantage.session import spread, table

from .shapes import RING_SQL



def key():
    return F.col("p_partkey")


def _e(x, n):
    return F.rint(x * n).cast("long")


def part_walls(spark, sf_dir):
    """id, wall, x0, y0, x1, y1: the four walls of each part's ring, counter-clockwise; w and h go with them."""
    x, y, w, h = (c.cast("double") for c in (key() % 97, key() % 89, key() % 5 + 1, key() % 3 + 1))
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    sides = F.array(*(F.struct(F.lit(k).alias("wall"), *(c.alias(n) for c, n in zip((*a, *b), ("x0", "y0", "x1", "y1")))) for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))))
    return spread(spark, sf_dir, "part", "p_partkey").select(key().alias("id"), w.alias("w"), h.alias("h"), F.explode(sides).alias("s")).select("id", "w", "h", "s.*")


def roof_planes(spark, sf_dir):
    """The plane through each customer's orders."""
    o = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select("o_custkey", (o % 37).cast("double").alias("x"), (o * 7 % 41).cast("double").alias("y"), F.when(o % 11 > 0, (o % 23 * 5000).cast("double")).alias("z"))
    f = so.plane_fit(p, ["o_custkey"])  # heights are in ten thousandths, so that halves stay halves
    return f.select("o_custkey", "n", *(_e(F.col(c), 1).alias(c) for c in "abc"))


def affine_map(spark, sf_dir):
    """The map from parts' places to their moved places, found in spite of every 17th, which is far off."""
    far = F.when(key() % 17 == 0, 400.0).otherwise(0.0)
    x, y = (key() % 83).cast("double"), (key() * 7 % 79).cast("double")
    p = table(spark, sf_dir, "part").select(x.alias("x"), y.alias("y"), (2 * x - 0.5 * y + 3 + (key() % 5 - 2) * 0.25 + far).alias("u"), (0.25 * x + 1.5 * y - 8 + (key() % 7 - 3) * 0.25 - far).alias("v"))
    m, n = so.affine_fit(p)
    return spark.createDataFrame([(*(round(v * 1000) for v in m), n)], "a long, b long, c long, d long, e long, f long, n long")


def affine_chain(spark, sf_dir):
    """Each part's place under two maps after each other."""
    m = [F.lit(1.0) + key() % 3, key() % 2 * 0.5, -(key() % 4) * 0.25, F.lit(2.0), key() % 7 * 1.0, F.lit(-3.0)]
    n = [F.lit(0.5), F.lit(0.25), key() % 5 * 0.5, F.lit(-1.0), F.lit(4.0), key() % 9 * 1.0]
    x, y = so.affine_apply(so.affine_concat(m, n), (key() % 97).cast("double"), (key() % 89).cast("double"))
    return table(spark, sf_dir, "part").select(key().alias("id"), _e(x, 1000).alias("x_e3"), _e(y, 1000).alias("y_e3"))


def polyline_segments(spark, sf_dir):
    """Segments of each part's ring, closed for odd parts only."""
    v = part_walls(spark, sf_dir).select("id", "wall", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("id") % 2 == 1).alias("closed"))
    s = so.polyline_segments(v, ["id"], "wall", "closed")
    return s.select("id", "seg", *(F.col(c).cast("long").alias(c) for c in ("ax", "ay", "bx", "by")))


def plan_shift(spark, sf_dir):
    """How far each part's drawn walls have to move to lie on its own."""
    w = part_walls(spark, sf_dir)
    dx, dy = F.col("id") % 4 * 0.25, F.col("id") % 3 * -0.5
    drawn = w.where("id % 7 <> wall").select("id", (F.col("x0") - dx).alias("ax"), (F.col("y0") - dy).alias("ay"), (F.col("x1") - dx).alias("bx"), (F.col("y1") - dy).alias("by"))
    s = so.best_shift(w.select("id", "wall", "x0", "y0", "x1", "y1"), drawn, ["id"], 1.0, 0.25, 0.1)
    return s.select("id", _e(F.col("dx"), 100).alias("dx_e2"), _e(F.col("dy"), 100).alias("dy_e2"))


def plan_lines(spark, sf_dir):
    """id, seg, ax, ay, bx, by: five lines for each part that run off its walls."""
    x, y, h = (key() % 97).cast("double"), (key() % 89).cast("double"), (key() % 3 + 1).cast("double")
    rows = [(x + 0.2, y - 0.1, x + 0.2, y + 0.7), (x + 0.9 + key() % 4 * 0.1, y + 0.05, x + 0.9 + key() % 4 * 0.1, y + 0.4 + key() % 5 * 0.1), (x + 0.5, y + 0.1, x + 0.7, y + 0.6), (x - 0.2, y + 0.3, x + 0.9, y + 0.3), (x + 0.1, y + h - 0.15 - key() % 2 * 0.1, x + 0.65, y + h - 0.15 - key() % 2 * 0.1)]
    each = F.array(*(F.struct(F.lit(k).alias("seg"), *(c.alias(n) for c, n in zip(r, ("ax", "ay", "bx", "by")))) for k, r in enumerate(rows)))
    return table(spark, sf_dir, "part").select(key().alias("id"), F.explode(each).alias("s")).select("id", "s.*")


def _stubs(spark, sf_dir):
    return so.stubs(part_walls(spark, sf_dir), plan_lines(spark, sf_dir), ["id"])


def wall_stubs(spark, sf_dir):
    """Lines that run squarely into each part from a wall."""
    return _stubs(spark, sf_dir).select("id", "wall", "seg", *(_e(F.col(c), 1000).alias(c) for c in ("s", "depth", "length")))


def door_passages(spark, sf_dir):
    """The best pair of such lines on each wall."""
    p = so.passages(_stubs(spark, sf_dir), ["id"])
    return p.select("id", "wall", *(_e(F.col(c), 1000).alias(c) for c in ("s", "width", "depth")))


def ranked_doors(spark, sf_dir):
    """Door candidates of each part, the surest first."""
    k = F.col("p_partkey")
    gaps = table(spark, sf_dir, "part").select(k.alias("id"), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("wall")).select("id", "wall", ((F.col("id") + F.col("wall")) % 6 * 0.375 + 0.11).alias("s"), (F.col("id") % 5 * 0.25 + 0.3).alias("width"))
    r = so.rank_openings(so.passages(_stubs(spark, sf_dir), ["id"]), gaps, ["id"])
    return r.select("id", "place", "wall", "confidence", _e(F.col("s"), 1000).alias("s"), _e(F.col("width"), 1000).alias("width"))


def _holes(spark, sf_dir):
    """Two rectangles on each part's first wall."""
    a = [(0.25 + key() % 3 * 0.25, 0.5 + key() % 3 * 0.25 + key() % 4 * 0.125, 0.5 + key() % 2 * 0.25, 1.0 + key() % 5 * 0.25), (0.5 - key() % 2 * 0.75, 0.75 + key() % 7 * 0.125, 0.75 + key() % 3 * 0.25, 1.25 + key() % 4 * 0.25)]
    each = F.array(*(F.struct(F.lit(i).alias("hole"), *(c.cast("double").alias(n) for c, n in zip(r, ("s0", "s1", "z0", "z1")))) for i, r in enumerate(a)))
    return table(spark, sf_dir, "part").select(key().alias("id"), F.explode(each).alias("h")).select("id", "h.*")


def panel_area(spark, sf_dir):
    """Area of each part's first wall beside its two holes, in millionths; base and top lean."""
    panels = table(spark, sf_dir, "part").select(key().alias("id"), (key() % 5 + 1).cast("double").alias("length"), F.lit(0.0).alias("zb0"), (key() % 3 * 0.125).cast("double").alias("zb1"), F.lit(2.5).alias("zt0"), (key() % 4 * 0.25 + 2.5).cast("double").alias("zt1"))
    b = so.panel_bands(panels, _holes(spark, sf_dir).drop("hole"), ["id"])
    area = (F.col("s1") - F.col("s0")) * (F.col("hi0") - F.col("lo0") + F.col("hi1") - F.col("lo1")) / 2
    return b.groupBy("id").agg(_e(F.sum(area), 1e6).alias("area_e6"))


def _opening(spark, sf_dir):
    s0 = (key() % 2 * 0.25 + 0.125).cast("double")
    return table(spark, sf_dir, "part").select(key().alias("id"), F.lit(0).alias("wall"), s0.alias("s0"), (s0 + 0.5).alias("s1"), (key() % 2 * 0.75).cast("double").alias("z0"), (key() % 2 * 0.75 + 1.0).cast("double").alias("z1"), F.when(key() % 3 == 0, key() % 4 * 0.125 + 0.125).cast("double").alias("pocket"))


def shell_measures(spark, sf_dir):
    """Triangles and area of each part's outer faces with one opening and the returns round it."""
    walls = part_walls(spark, sf_dir).withColumns({"zb": F.lit(0.0), "zt": F.lit(2.5)})
    t = so.shell(walls, _opening(spark, sf_dir), ["id"], 0.5)
    tris = t.withColumnRenamed("id", "bid")
    return ms.measures(tris).select("bid", "n", _e(F.col("area"), 1e6).alias("area_e6"))


def reveal_faces(spark, sf_dir):
    """Faces round each part's opening, by kind."""
    o = _opening(spark, sf_dir).select("id", F.col("s0").alias("ax"), F.lit(0.0).alias("ay"), F.col("s1").alias("bx"), F.lit(0.0).alias("by"), F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.coalesce("pocket", F.lit(0.5)).alias("depth"), "z0", "z1", F.lit(0.0).alias("floor"), F.col("pocket").isNotNull().alias("pocket"))
    return so.reveals(o, ["id"]).groupBy("id", "part").agg(F.count("*").alias("n"), _e(F.max("r.y"), 1000).alias("far_e3"), _e(F.max("r.z"), 1000).alias("top_e3"))


def dome_meshes(spark, sf_dir):
    """Triangles and area of a dome over each part."""
    d = table(spark, sf_dir, "part").select(key().alias("bid"), (key() % 97).cast("double").alias("x"), (key() % 89).cast("double").alias("y"), F.lit(2.0).alias("spring"), (key() % 4 * 0.5 + 1).cast("double").alias("radius"))
    t = so.dome_mesh(d, ["bid"], 8, 2)
    return ms.measures(t).select("bid", "n", _e(F.col("area"), 1e4).alias("area_e4"))


def closed_boxes(spark, sf_dir):
    """Checks of each part's box; every fourth has no floor, and every tenth is measured against a wrong volume."""
    w = part_walls(spark, sf_dir)
    box = w.where("wall = 0").select("id", "x0", "y0", "x1", (F.col("y0") + F.col("h")).alias("y1"), "w", "h")
    top = F.lit(2.5)
    sides = ms.box_triangles(box, F.lit(0.0), top).select("bid", "ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz")
    p = lambda a, b: so.point(F.col(a), F.col(b), F.lit(0.0))
    floor = so.quads_to_triangles(box.where("id % 4 <> 0").select(F.col("id").alias("bid"), p("x0", "y0").alias("p"), p("x0", "y1").alias("q"), p("x1", "y1").alias("r"), p("x1", "y0").alias("t")), ["bid"])
    tris = sides.unionByName(floor.drop("half"))
    asked = box.select(F.col("id").alias("bid"), (F.col("w") * F.col("h") * 2.5 + F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0)).alias("volume"))
    return so.mesh_checks(ms.measures(tris), ms.open_edges(tris), asked.where("bid % 4 <> 0 OR bid % 8 = 0"))


def clear_spots(spark, sf_dir):
    """Where up to two openings go on each part's wall, with a door or without; wide ones without a door may overlap."""
    length, width = (key() % 5 + 1).cast("double"), (key() % 7 % 3 * 0.25 + 0.25).cast("double")
    door = F.when(key() % 4 > 0, key() % 4 * 0.75).cast("double")
    s = so.clear_spots(length, (key() % 3).cast("int"), width, door, F.lit(0.5))
    return table(spark, sf_dir, "part").select(key().alias("id"), F.size(s).alias("n"), _e(F.coalesce(F.array_max(s), F.lit(0.0)), 1000).alias("last_e3"), _e(F.coalesce(F.array_min(s), F.lit(0.0)), 1000).alias("first_e3"))


def stacked_spots(spark, sf_dir):
    """Niches of each part's wall: under a window where there is room, then beside it."""
    windows = F.array(F.struct((key() % 4 * 0.5 + 0.5).cast("double").alias("s"), (key() % 3 * 0.5 + 0.5).cast("double").alias("sill")))
    spots = F.array(F.lit(1.0), F.lit(2.25))
    r = so.stacked_spots((key() % 3 + 1).cast("int"), windows, spots, F.lit(0.5), F.lit(0.7), F.lit(0.5))
    return table(spark, sf_dir, "part").select(key().alias("id"), F.posexplode(r).alias("k", "r")).select("id", "k", _e(F.col("r.s"), 100).alias("s_e2"), _e(F.col("r.head"), 100).alias("head_e2"), "r.stacked")


def floor_points(spark, sf_dir):
    """Points of each part's floor that keep off its walls."""
    f = so.floor_points(part_walls(spark, sf_dir), ["id"], 0.8, 0.5)
    return f.groupBy("id").agg(F.count("*").alias("n"), _e(F.min("clear"), 1000).alias("clear_e3"), _e(F.sum("px"), 1000).alias("px_e3"))


def wall_clearance(spark, sf_dir):
    """How far a point by each part is from its walls, and whether it is inside."""
    pts = table(spark, sf_dir, "part").select(key().alias("id"), F.lit(0).alias("k"), (key() % 97 + key() % 7 * 0.5 + 0.1).cast("double").alias("px"), (key() % 89 + key() % 11 * 0.25 + 0.1).cast("double").alias("py"))
    return so.clearance(pts, part_walls(spark, sf_dir), ["id"], "k").select("id", "inside", _e(F.col("clear"), 1e6).alias("clear_e6"))


def built_thickness(spark, sf_dir):
    """The thickness that each part's walls are built at."""
    w = part_walls(spark, sf_dir)
    d = so.inner_discs(w, "id").join(w.groupBy("id").agg((F.count("*") + F.when(F.col("id") % 9 == 0, 30).otherwise(0)).alias("vertices")), "id")
    return d.select("id", _e(so.built_thickness(F.lit(0.45), F.col("vertices"), F.col("radius"), 0.25), 100).alias("thickness_e2"))


def door_targets(spark, sf_dir):
    """Door normals of each part, the target inside, its height, and whether there is headroom over it."""
    side = F.col("id") % 4
    w = part_walls(spark, sf_dir).where(F.col("wall") == side)
    d = w.select("id", "x0", "y0", "x1", "y1", F.lit(0.5).alias("s"), F.lit(0.8).alias("width"), (F.col("id") % 97 + F.col("w") / 2).alias("ix"), (F.col("id") % 89 + F.col("h") / 2).alias("iy"))
    f = so.door_frames(d).withColumn("z", so.target_height(F.when(F.col("id") % 6 > 0, (F.col("id") % 6).cast("double")), F.lit(0.0), F.lit(1.8)))
    return f.where("z IS NULL OR 4.5 - z >= 0.6").select("id", _e(F.col("nx"), 1).alias("nx"), _e(F.col("ny"), 1).alias("ny"), _e(F.col("tx"), 100).alias("tx_e2"), _e(F.col("ty"), 100).alias("ty_e2"), _e(F.col("z"), 1000).alias("z_e3"))


QUERIES = {f.__name__: f for f in (roof_planes, affine_map, affine_chain, polyline_segments, plan_shift, wall_stubs, door_passages, ranked_doors, panel_area, shell_measures, reveal_faces, dome_meshes, closed_boxes, clear_spots, stacked_spots, floor_points, wall_clearance, built_thickness, door_targets)}

WALLS_SQL = f"""{RING_SQL}, walls AS (SELECT id, w, h, CAST(e AS INTEGER) AS wall, [x, x + w, x + w, x][e + 1]::DOUBLE AS x0, [y, y, y + h, y + h][e + 1]::DOUBLE AS y0, [x + w, x + w, x, x][e + 1]::DOUBLE AS x1, [y, y + h, y + h, y][e + 1]::DOUBLE AS y1 FROM s, range(4) t(e))"""
STUBS_SQL = f"""{WALLS_SQL}, lines AS (SELECT id, 0 AS seg, x + 0.2::DOUBLE AS ax, y - 0.1::DOUBLE AS ay, x + 0.2::DOUBLE AS bx, y + 0.7::DOUBLE AS "by" FROM s
    UNION ALL SELECT id, 1, x + 0.9::DOUBLE + id % 4 * 0.1::DOUBLE, y + 0.05::DOUBLE, x + 0.9::DOUBLE + id % 4 * 0.1::DOUBLE, y + 0.4::DOUBLE + id % 5 * 0.1::DOUBLE FROM s
    UNION ALL SELECT id, 2, x + 0.5::DOUBLE, y + 0.1::DOUBLE, x + 0.7::DOUBLE, y + 0.6::DOUBLE FROM s UNION ALL SELECT id, 3, x - 0.2::DOUBLE, y + 0.3::DOUBLE, x + 0.9::DOUBLE, y + 0.3::DOUBLE FROM s
    UNION ALL SELECT id, 4, x + 0.1::DOUBLE, y + h - 0.15::DOUBLE - id % 2 * 0.1::DOUBLE, x + 0.65::DOUBLE, y + h - 0.15::DOUBLE - id % 2 * 0.1::DOUBLE FROM s),
  framed AS (SELECT id, wall, seg, CASE WHEN wall % 2 = 0 THEN w ELSE h END AS len, abs(CASE WHEN wall % 2 = 0 THEN bx - ax ELSE "by" - ay END) AS lean, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS length,
      CASE wall WHEN 0 THEN ax - x0 WHEN 1 THEN ay - y0 WHEN 2 THEN x0 - ax ELSE y0 - ay END AS sa, CASE wall WHEN 0 THEN bx - x0 WHEN 1 THEN "by" - y0 WHEN 2 THEN x0 - bx ELSE y0 - "by" END AS sb,
      CASE wall WHEN 0 THEN y0 - ay WHEN 1 THEN ax - x0 WHEN 2 THEN ay - y0 ELSE x0 - ax END AS na, CASE wall WHEN 0 THEN y0 - "by" WHEN 1 THEN bx - x0 WHEN 2 THEN "by" - y0 ELSE x0 - bx END AS nb FROM walls JOIN lines USING (id)),
  stubs AS (SELECT id, wall, seg, (sa + sb) / 2 AS s, -least(na, nb) AS depth, length FROM framed WHERE length BETWEEN 0.15 AND 4 AND lean <= 0.35 * length AND least(abs(na), abs(nb)) <= 0.6 AND -least(na, nb) BETWEEN 0.3 AND 3 AND (sa + sb) / 2 BETWEEN -0.1 AND len + 0.1),
  pairs AS (SELECT a.id, a.wall, (a.s + b.s) / 2 AS s, b.s - a.s AS width, least(a.depth, b.depth) AS depth, a.s AS first FROM stubs a JOIN stubs b ON a.id = b.id AND a.wall = b.wall AND b.s - a.s BETWEEN 0.5 AND 1.6),
  doors AS (SELECT id, wall, s, width, depth FROM pairs QUALIFY row_number() OVER (PARTITION BY id, wall ORDER BY depth DESC, abs(width - 0.9::DOUBLE), first) = 1)"""
ORACLES = {
    "roof_planes": """WITH p AS (SELECT o_custkey, CAST(o_orderkey % 37 AS DOUBLE) AS x, CAST(o_orderkey * 7 % 41 AS DOUBLE) AS y, o_orderkey % 23 * 0.5::DOUBLE AS z FROM orders WHERE o_orderkey % 11 > 0),
      m AS (SELECT o_custkey, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM p GROUP BY 1),
      f AS (SELECT *, CASE WHEN n >= 3 AND xx * yy - xy * xy > 1e-9 * xx * yy THEN (xz * yy - yz * xy) / (xx * yy - xy * xy) ELSE 0 END AS a, CASE WHEN n >= 3 AND xx * yy - xy * xy > 1e-9 * xx * yy THEN (yz * xx - xz * xy) / (xx * yy - xy * xy) ELSE 0 END AS b FROM m)
      SELECT o_custkey, n, CAST(round_even(a * 10000, 0) AS BIGINT) AS a, CAST(round_even(b * 10000, 0) AS BIGINT) AS b, CAST(round_even((mz - a * mx - b * my) * 10000, 0) AS BIGINT) AS c FROM f""",
    "affine_map": """WITH p AS (SELECT p_partkey % 83 AS x, p_partkey * 7 % 79 AS y, p_partkey AS k FROM part WHERE p_partkey % 17 <> 0), q AS (SELECT x, y, 2 * x - 0.5::DOUBLE * y + 3 + (k % 5 - 2) * 0.25::DOUBLE AS u, 0.25::DOUBLE * x + 1.5::DOUBLE * y - 8 + (k % 7 - 3) * 0.25::DOUBLE AS v FROM p),
      m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM q),
      s AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS c, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS b, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS d FROM m)
      SELECT CAST(round(a * 1000) AS BIGINT) AS a, CAST(round(b * 1000) AS BIGINT) AS b, CAST(round(c * 1000) AS BIGINT) AS c, CAST(round(d * 1000) AS BIGINT) AS d, CAST(round((mu - a * mx - c * my) * 1000) AS BIGINT) AS e, CAST(round((mv - b * mx - d * my) * 1000) AS BIGINT) AS f, n FROM s""",
    "affine_chain": """WITH p AS (SELECT p_partkey AS id, p_partkey % 97 AS x, p_partkey % 89 AS y FROM part), m AS (SELECT id, (1.0::DOUBLE + id % 3) * x - id % 4 * 0.25::DOUBLE * y + id % 7 AS x, id % 2 * 0.5::DOUBLE * x + 2 * y - 3 AS y FROM p)
      SELECT id, CAST(round_even((0.5::DOUBLE * x + id % 5 * 0.5::DOUBLE * y + 4) * 1000, 0) AS BIGINT) AS x_e3, CAST(round_even((0.25::DOUBLE * x - y + id % 9) * 1000, 0) AS BIGINT) AS y_e3 FROM m""",
    "polyline_segments": f"WITH {WALLS_SQL} SELECT id, wall AS seg, CAST(x0 AS BIGINT) AS ax, CAST(y0 AS BIGINT) AS ay, CAST(x1 AS BIGINT) AS bx, CAST(y1 AS BIGINT) AS \"by\" FROM walls WHERE wall < 3 OR id % 2 = 1",
    "plan_shift": f"""WITH {WALLS_SQL}, drawn AS (SELECT id, x0 - id % 4 * 0.25::DOUBLE AS ax, y0 + id % 3 * 0.5::DOUBLE AS ay, x1 - id % 4 * 0.25::DOUBLE AS bx, y1 + id % 3 * 0.5::DOUBLE AS "by" FROM walls WHERE id % 7 <> wall),
      moved AS (SELECT id, wall, w, h, x0, y0, i, j, ax + i * 0.25::DOUBLE AS ax, ay + j * 0.25::DOUBLE AS ay, bx + i * 0.25::DOUBLE AS bx, "by" + j * 0.25::DOUBLE AS "by" FROM walls JOIN drawn USING (id), range(-4, 5) a(i), range(-4, 5) b(j)),
      f AS (SELECT *, CASE WHEN wall % 2 = 0 THEN w ELSE h END AS len, CASE WHEN wall % 2 = 0 THEN greatest(abs(ay - y0), abs("by" - y0)) ELSE greatest(abs(ax - x0), abs(bx - x0)) END AS off,
          CASE wall WHEN 0 THEN ax - x0 WHEN 1 THEN ay - y0 WHEN 2 THEN x0 - ax ELSE y0 - ay END AS sa, CASE wall WHEN 0 THEN bx - x0 WHEN 1 THEN "by" - y0 WHEN 2 THEN x0 - bx ELSE y0 - "by" END AS sb FROM moved),
      c AS (SELECT id, i, j, sum(CASE WHEN off <= 0.1 THEN round_even((least(greatest(greatest(sa, sb), 0), len) - least(greatest(least(sa, sb), 0), len)) * 1000, 0) ELSE 0 END) AS cover FROM f GROUP BY 1, 2, 3),
      b AS (SELECT id, i, j, cover, max(cover) FILTER (i = 0 AND j = 0) OVER (PARTITION BY id) AS still FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY cover DESC, i, j) = 1)
      SELECT id, CAST(CASE WHEN still >= 0.95 * cover THEN 0 ELSE i * 25 END AS BIGINT) AS dx_e2, CAST(CASE WHEN still >= 0.95 * cover THEN 0 ELSE j * 25 END AS BIGINT) AS dy_e2 FROM b""",
    "wall_stubs": f"WITH {STUBS_SQL} SELECT id, wall, seg, CAST(round_even(s * 1000, 0) AS BIGINT) AS s, CAST(round_even(depth * 1000, 0) AS BIGINT) AS depth, CAST(round_even(length * 1000, 0) AS BIGINT) AS length FROM stubs",
    "door_passages": f"WITH {STUBS_SQL} SELECT id, wall, CAST(round_even(s * 1000, 0) AS BIGINT) AS s, CAST(round_even(width * 1000, 0) AS BIGINT) AS width, CAST(round_even(depth * 1000, 0) AS BIGINT) AS depth FROM doors",
    "ranked_doors": f"""WITH {STUBS_SQL}, gaps AS (SELECT p_partkey AS id, CAST(wall AS INTEGER) AS wall, (p_partkey + wall) % 6 * 0.375::DOUBLE + 0.11::DOUBLE AS s, p_partkey % 5 * 0.25::DOUBLE + 0.3::DOUBLE AS width FROM part, range(4) t(wall) WHERE wall <= p_partkey % 4),
      met AS (SELECT d.id, d.wall, g.s AS gs FROM doors d JOIN gaps g USING (id, wall) WHERE abs(g.s - d.s) < greatest(0.6, d.width) QUALIFY row_number() OVER (PARTITION BY d.id, d.wall ORDER BY g.s) = 1),
      c AS (SELECT d.id, d.wall, d.s, d.width, CASE WHEN m.gs IS NOT NULL THEN 'high' WHEN depth >= 0.5 AND width BETWEEN 0.6 AND 1.5 THEN 'med' ELSE 'low' END AS confidence FROM doors d LEFT JOIN met m USING (id, wall)
        UNION ALL SELECT g.id, g.wall, g.s, g.width, 'low' FROM gaps g LEFT JOIN met m ON m.id = g.id AND m.wall = g.wall AND m.gs = g.s WHERE m.gs IS NULL),
      l AS (SELECT id, wall, s, width, CASE WHEN count(*) OVER (PARTITION BY id) > 3 THEN 'low' ELSE confidence END AS confidence FROM c)
      SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY list_position(['high', 'med', 'low'], confidence), width DESC, wall, s) AS INTEGER) AS place, wall, confidence, CAST(round_even(s * 1000, 0) AS BIGINT) AS s, CAST(round_even(width * 1000, 0) AS BIGINT) AS width FROM l""",
    "panel_area": """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS len, 2.5::DOUBLE + (2.5::DOUBLE + p_partkey % 4 * 0.25::DOUBLE - p_partkey % 3 * 0.125::DOUBLE) AS sides,
        greatest(0.25::DOUBLE + p_partkey % 3 * 0.25::DOUBLE, 0) AS a0, 0.5::DOUBLE + p_partkey % 3 * 0.25::DOUBLE + p_partkey % 4 * 0.125::DOUBLE AS a1, 0.5::DOUBLE + p_partkey % 2 * 0.25::DOUBLE AS az0, 1 + p_partkey % 5 * 0.25::DOUBLE AS az1,
        greatest(0.5::DOUBLE - p_partkey % 2 * 0.75::DOUBLE, 0) AS b0, 0.75::DOUBLE + p_partkey % 7 * 0.125::DOUBLE AS b1, 0.75::DOUBLE + p_partkey % 3 * 0.25::DOUBLE AS bz0, 1.25::DOUBLE + p_partkey % 4 * 0.25::DOUBLE AS bz1 FROM part),
      c AS (SELECT id, len, sides, a0, least(a1, len) AS a1, az0, az1, b0, least(b1, len) AS b1, bz0, bz1 FROM p),
      h AS (SELECT id, len * sides / 2 AS whole, greatest(a1 - a0, 0) * (az1 - az0) + greatest(b1 - b0, 0) * (bz1 - bz0) - greatest(least(a1, b1) - greatest(a0, b0), 0) * greatest(least(az1, bz1) - greatest(az0, bz0), 0) AS holes FROM c)
      SELECT id, CAST(round_even((whole - holes) * 1e6, 0) AS BIGINT) AS area_e6 FROM h""",
    "shell_measures": """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS w, p_partkey % 3 + 1 AS h, p_partkey % 2 AS up, p_partkey % 3 = 0 AS pocket, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 * 0.125::DOUBLE + 0.125::DOUBLE ELSE 0.5 END AS d, p_partkey % 2 * 0.25::DOUBLE + 0.125::DOUBLE AS s0 FROM part)
      SELECT id AS bid, CAST(2 * (3 + CASE WHEN s0 + 0.5 < w THEN 2 ELSE 1 END + 1 + up + 3 + up + CASE WHEN pocket THEN 1 ELSE 0 END) AS BIGINT) AS n,
        CAST(round_even((2 * (w + h) * 2.5::DOUBLE - 0.5::DOUBLE + 2 * d + 0.5::DOUBLE * d * (1 + up) + CASE WHEN pocket THEN 0.5 ELSE 0 END) * 1e6, 0) AS BIGINT) AS area_e6 FROM p""",
    "reveal_faces": """WITH p AS (SELECT p_partkey AS id, p_partkey % 2 AS up, p_partkey % 3 = 0 AS pocket, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 * 0.125::DOUBLE + 0.125::DOUBLE ELSE 0.5 END AS d FROM part),
      f AS (SELECT *, unnest(['jamb', 'soffit', 'sill', 'back']) AS part FROM p)
      SELECT id, part, CAST(CASE WHEN part = 'jamb' THEN 2 ELSE 1 END AS BIGINT) AS n, CAST(round_even(d * 1000, 0) AS BIGINT) AS far_e3, CAST(CASE WHEN part = 'sill' THEN up * 750 ELSE 1000 + up * 750 END AS BIGINT) AS top_e3 FROM f
      WHERE part IN ('jamb', 'soffit') OR (part = 'sill' AND up = 1) OR (part = 'back' AND pocket)""",
    "dome_meshes": """WITH p AS (SELECT p_partkey AS bid, p_partkey % 4 * 0.5::DOUBLE + 1 AS r FROM part), e AS (SELECT *, r * cos(pi() / 4) AS rm, r * sin(pi() / 4) AS z, 2 * sin(pi() / 8) AS chord FROM p),
      a AS (SELECT bid, r * chord AS c0, rm * chord AS c1, sqrt(power((r - rm) * cos(pi() / 8), 2) + z * z) AS slant, sqrt(power(rm * cos(pi() / 8), 2) + power(r - z, 2)) AS fan FROM e)
      SELECT bid, CAST(24 AS BIGINT) AS n, CAST(round_even(8 * ((c0 + c1) / 2 * slant + c1 / 2 * fan) * 1e4, 0) AS BIGINT) AS area_e4 FROM a""",
    "closed_boxes": """WITH p AS (SELECT p_partkey AS bid FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 8 = 0), c AS (SELECT bid, unnest(['not empty', 'volume', 'even edges']) AS label FROM p)
      SELECT bid, label, CASE label WHEN 'not empty' THEN true WHEN 'even edges' THEN bid % 4 <> 0 ELSE bid % 4 <> 0 AND bid % 10 <> 0 END AS ok FROM c WHERE label <> 'volume' OR bid % 4 <> 0
      UNION ALL SELECT bid, 'volume', false FROM p WHERE bid % 4 = 0""",
    "clear_spots": """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 + 1 AS len, p_partkey % 3 AS n, p_partkey % 7 % 3 * 0.25::DOUBLE + 0.25::DOUBLE AS w, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 * 0.75::DOUBLE END AS door FROM part),
      b AS (SELECT *, w / 2 + 0.05::DOUBLE AS half, door - 0.25::DOUBLE - 0.3::DOUBLE - (w / 2 + 0.05::DOUBLE) AS lo, door + 0.25::DOUBLE + 0.3::DOUBLE + (w / 2 + 0.05::DOUBLE) AS hi FROM p),
      s AS (SELECT *, i, CAST(len * i AS DOUBLE) / (n + 1) AS s, CASE WHEN lo >= half AND lo <= len - half THEN lo END AS a, CASE WHEN hi >= half AND hi <= len - half THEN hi END AS z FROM b, range(1, 3) t(i) WHERE i <= n),
      m AS (SELECT id, i, w, len, half, door, CASE WHEN door IS NOT NULL AND s > lo AND s < hi THEN CASE WHEN a IS NULL OR z - s < s - a THEN z ELSE a END ELSE s END AS s FROM s),
      f AS (SELECT id, i, w, s, door FROM m WHERE s >= half AND s <= len - half), k AS (SELECT x.id, x.s FROM f x LEFT JOIN f y ON y.id = x.id AND y.i = 1 AND x.i = 2 WHERE x.door IS NULL OR y.s IS NULL OR abs(x.s - y.s) > x.w + 0.05::DOUBLE)
      SELECT p.id, CAST(count(k.s) AS INTEGER) AS n, CAST(round_even(coalesce(max(k.s), 0) * 1000, 0) AS BIGINT) AS last_e3, CAST(round_even(coalesce(min(k.s), 0) * 1000, 0) AS BIGINT) AS first_e3 FROM p LEFT JOIN k USING (id) GROUP BY p.id""",
    "stacked_spots": """WITH p AS (SELECT p_partkey AS id, p_partkey % 3 + 1 AS n, p_partkey % 4 * 0.5::DOUBLE + 0.5::DOUBLE AS ws, p_partkey % 3 * 0.5::DOUBLE + 0.5::DOUBLE AS sill FROM part),
      st AS (SELECT id, n, ws, least(1.2::DOUBLE, sill - 0.06::DOUBLE) AS head FROM p), ok AS (SELECT *, head - 0.7::DOUBLE >= 0.15 AS up FROM st),
      fr AS (SELECT id, n, up, unnest([1.0::DOUBLE, 2.25::DOUBLE]) AS s, ws FROM ok), fits AS (SELECT id, n, up, s, row_number() OVER (PARTITION BY id ORDER BY s) AS k FROM fr WHERE NOT up OR abs(s - ws) >= 0.55::DOUBLE),
      alls AS (SELECT id, 0 AS k, ws AS s, head, true AS stacked FROM ok WHERE up UNION ALL SELECT id, k - 1 + CASE WHEN up THEN 1 ELSE 0 END, s, 1.2::DOUBLE, false FROM fits WHERE k + CASE WHEN up THEN 1 ELSE 0 END <= n)
      SELECT id, CAST(k AS INTEGER) AS k, CAST(round_even(s * 100, 0) AS BIGINT) AS s_e2, CAST(round_even(head * 100, 0) AS BIGINT) AS head_e2, stacked FROM alls""",
    "floor_points": f"""WITH {RING_SQL}, l AS (SELECT id, x + (i + 0.5::DOUBLE) * 0.5 AS px, least(least((i + 0.5::DOUBLE) * 0.5, w - (i + 0.5::DOUBLE) * 0.5), least((j + 0.5::DOUBLE) * 0.5, h - (j + 0.5::DOUBLE) * 0.5)) AS clear FROM s, range(10) a(i), range(6) b(j) WHERE i * 0.5 < w AND j * 0.5 < h),
      k AS (SELECT *, max(clear) OVER (PARTITION BY id) >= 0.8 AS wide FROM l WHERE clear >= 0.05)
      SELECT id, count(*) AS n, CAST(round_even(min(clear) * 1000, 0) AS BIGINT) AS clear_e3, CAST(round_even(sum(px) * 1000, 0) AS BIGINT) AS px_e3 FROM k WHERE NOT wide OR clear >= 0.8 GROUP BY id""",
    "wall_clearance": f"""WITH {RING_SQL}, p AS (SELECT *, id % 7 * 0.5::DOUBLE + 0.1::DOUBLE AS u, id % 11 * 0.25::DOUBLE + 0.1::DOUBLE AS v FROM s)
      SELECT id, u < w AND v < h AS inside, CAST(round_even(CASE WHEN u < w AND v < h THEN least(least(u, w - u), least(v, h - v)) ELSE sqrt(greatest(u - w, 0) * greatest(u - w, 0) + greatest(v - h, 0) * greatest(v - h, 0)) END * 1e6, 0) AS BIGINT) AS clear_e6 FROM p""",
    "built_thickness": f"WITH {RING_SQL} SELECT id, CAST(CASE WHEN id % 9 = 0 OR least(w, h) / 2.0 < 0.75 THEN 0 ELSE 45 END AS BIGINT) AS thickness_e2 FROM s",
    "door_targets": f"""WITH {WALLS_SQL}, d AS (SELECT id, wall, x0, y0, [0, 1, 0, -1][wall + 1] AS nx, [-1, 0, 1, 0][wall + 1] AS ny, [1, 0, -1, 0][wall + 1] AS ux, [0, 1, 0, -1][wall + 1] AS uy, CASE WHEN id % 6 > 0 THEN id % 6 + 0.9::DOUBLE END AS z FROM walls WHERE wall = id % 4)
      SELECT id, CAST(nx AS BIGINT) AS nx, CAST(ny AS BIGINT) AS ny, CAST(round_even((x0 + ux * 0.5 - 0.5 * nx) * 100, 0) AS BIGINT) AS tx_e2, CAST(round_even((y0 + uy * 0.5 - 0.5 * ny) * 100, 0) AS BIGINT) AS ty_e2, CAST(round_even(z * 1000, 0) AS BIGINT) AS z_e3 FROM d WHERE z IS NULL OR 4.5 - z >= 0.6""",
}
