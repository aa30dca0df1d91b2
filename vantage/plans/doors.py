"""Queries of openings' places, stations and anchors, of cameras and of envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions import text as t
from vantage.operators import grid as g
from vantage.operators import openings as op
from vantage.operators import polygons as pg
from vantage.operators import rays as ry
from vantage.operators import visibility as v
from vantage.session import table

from .scenes import DEM_SQL, GRID, dem, eyes, los_sql

VIEW = (45.0, -10.0, 70.0, 64, 48)


def _e(x, k=1000):
    return F.rint(x * k).cast("long")


def _rings(spark, sf_dir):
    """A rectangle for each part, counter-clockwise from its lowest corner."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(F.array(*(F.struct((k % 97 + F.lit(a) * (k % 5 + 1)).cast("double").alias("x"), (k % 89 + F.lit(b) * (k % 3 + 1)).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))).alias("i", "p"))
    return p.select("id", "i", "p.x", "p.y")


def opening_axes(spark, sf_dir):
    """Openings spaced along a wall of each part: the station before each, its centre, the depth and the middle of its pocket, and how far its axis is from a fixed direction of the part."""
    k = F.col("id")
    walls = op.walls(_rings(spark, sf_dir), ["id"], "i").where("edge = id % 4")
    o = walls.select("*", F.posexplode(op.spaced(F.col("length"), (k % 3 + 1).cast("int"))).alias("n", "s"))
    o = o.withColumns({"thickness": (k % 4 * 0.1 + 0.2).cast("double"), "asked": (k % 9 * 0.05).cast("double"), "face": F.when(k % 5 == 0, "through").otherwise("in"), "ground": (k % 7).cast("double"), "z0": F.lit(0.5), "z1": (k % 4 * 0.5 + 0.5).cast("double")})
    o = op.stations(o).withColumn("depth", op.clamp_depth(F.col("asked"), F.col("thickness"), F.col("face")))
    pocket = op.recess_target(F.col("depth"), F.col("thickness"), F.col("cx"), F.col("cy"), F.col("nx"), F.col("ny"))
    off = op.axis_offset(-F.col("nx"), -F.col("ny"), F.lit(0.0), (k % 3 + 1).cast("double"), (k % 5 + 1).cast("double"), (k % 2).cast("double"))
    return o.withColumn("p", pocket).select("id", "n", *(_e(F.col(c)).alias(f"{c}_mm") for c in ("ex", "ey", "ez", "cx", "cy", "cz", "depth")), _e(F.col("p.x")).alias("px_mm"), _e(F.col("p.y")).alias("py_mm"), _e(off).alias("off_e3"))


def anchors_resolved(spark, sf_dir):
    """The wall of each part's opening after its ring has been numbered anew: by its anchor's azimuth and middle, by the nearest middle, or none."""
    k = F.col("p_partkey")
    walls = op.walls(_rings(spark, sf_dir), ["id"], "i")
    w, h = k % 5 + 1, k % 3 + 1
    side = (k % 4).cast("int")
    mx = k % 97 + F.when(side == 0, w / 2).when(side == 1, w).when(side == 2, w / 2).otherwise(0)
    my = k % 89 + F.when(side == 0, 0).when(side == 1, h / 2).when(side == 2, h).otherwise(h / 2)
    az = F.when(side == 0, 180.0).when(side == 1, 90.0).when(side == 2, 0.0).otherwise(270.0)
    drift = k % 6 * 0.75
    rows = table(spark, sf_dir, "part").select(k.alias("id"), ((side + 1) % 4).alias("wall"), F.when(k % 7 > 0, az).alias("wall_az"), (mx + drift).cast("double").alias("wall_mx"), (my + 0.125).cast("double").alias("wall_my"))
    return op.resolve_anchor(rows, walls, ["id"]).select("id", "edge", "status")


def facing_walls(spark, sf_dir):
    """The wall that faces each part's door, by where the openings face."""
    walls = op.walls(_rings(spark, sf_dir), ["id"], "i")
    return op.facing_wall(walls, walls.where("edge = id % 4"), ["id"]).select("id", "door", "facing")


def marks_in_frame(spark, sf_dir):
    """Where the observers round each one fall in the picture of a camera to the north-east, in thousandths of a pixel."""
    heights = dem(spark, sf_dir)
    pairs = v.observer_pairs(eyes(spark, sf_dir, heights), 12.0).where("eye <> other")
    d = [F.col(f"t{k}") - F.col(f"e{k}") for k in "xyz"]
    return pairs.withColumn("at", ry.project(*d, *VIEW)).where("at IS NOT NULL").select("eye", "other", _e(F.col("at.x")).alias("x_e3"), _e(F.col("at.y")).alias("y_e3"))


def _hits(spark, sf_dir, picture):
    heights = dem(spark, sf_dir)
    rays = eyes(spark, sf_dir, heights).crossJoin(F.broadcast(picture)).withColumn("f0", F.lit(-1.6))
    return v.first_hit(rays, g.corners(heights), GRID, ["eye", "px", "py"], 20.0).select("eye", "px", "py", _e(F.col("hit")).alias("hit_mm"))


def panorama_hits(spark, sf_dir):
    """Where the 12 x 4 pixels of each observer's panorama, all round, meet the ground."""
    return _hits(spark, sf_dir, ry.panorama(spark, 0.0, 360.0, -7.5, 120.0, 12))


def picture_hits(spark, sf_dir):
    """Where the 8 x 6 pixels of each observer's camera to the north-east meet the ground."""
    return _hits(spark, sf_dir, ry.perspective(spark, *VIEW[:3], 8, 6))


def largest_parts(spark, sf_dir):
    """The largest of each part's two to four rectangles, and its neighbours' names in short."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("id"), F.explode(F.sequence(F.lit(0), (k % 3 + 1).cast("int"))).alias("part"))
    size = lambda m: (F.col("id") * (F.col("part") + 3) % m + 1).cast("double")
    ring = F.array(*(F.struct((F.lit(a) * size(7)).alias("x"), (F.lit(b) * size(5)).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))))
    vertices = parts.select("id", "part", F.posexplode(ring).alias("i", "p")).select("id", "part", "i", "p.x", "p.y")
    names = F.transform(F.sequence(F.lit(1), (F.col("id") % 12 + 1).cast("int")), lambda j: (F.col("id") * 3 + j).cast("string"))
    top = pg.largest_part(vertices, ["id"], "part", "i")
    return pg.areas(top, ["id", "part"], "i").select("id", "part", F.col("area").cast("long").alias("area"), t.shorten(names).alias("names"))


def door_envelopes(spark, sf_dir):
    """From standing points on three distances and five directions before each observer's door: the share of four targets seen, the widest admitted angle; none where the ground is unknown."""
    heights = dem(spark, sf_dir)
    four = g.corners(heights)
    frames = eyes(spark, sf_dir, heights, 0.0).select(F.col("eye").alias("scene"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("floor"), F.lit(0.0).alias("nx"), F.lit(-1.0).alias("ny"))
    targets = frames.select("scene", F.posexplode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-0.75, 0.5), (0.75, 0.5), (-0.75, 2.5), (0.75, 2.5))))).alias("t", "o"), "x", "y", "floor").select("scene", "t", (F.col("x") + F.col("o.a")).alias("tx"), (F.col("y") + 0.25).alias("ty"), (F.col("floor") + F.col("o.b")).alias("tz"))
    out = ry.polar_envelope(frames, targets, four, GRID, "scene", (3.0, 5.0, 8.0), (-60.0, -30.0, 0.0, 30.0, 60.0), 1.6)
    return out.select("scene", "range", "angle", _e(F.col("share"), 4).alias("seen"), _e(F.col("widest")).alias("widest_e3"))


QUERIES = {f.__name__: f for f in (opening_axes, anchors_resolved, facing_walls, marks_in_frame, panorama_hits, picture_hits, largest_parts, door_envelopes)}

_MM = lambda x, k=1000: f"CAST(round_even(({x}) * {k}, 0) AS BIGINT)"
SIDES_SQL = """sides AS (SELECT p_partkey AS id, CAST(e AS INTEGER) AS edge, p_partkey % 97 AS bx, p_partkey % 89 AS by_, p_partkey % 5 + 1 AS w, p_partkey % 3 + 1 AS h, [0, 1, 0, -1][e + 1] AS nx, [-1, 0, 1, 0][e + 1] AS ny, [1, 0, -1, 0][e + 1] AS ux, [0, 1, 0, -1][e + 1] AS uy,
  [0, 1, 1, 0][e + 1] AS cx, [0, 0, 1, 1][e + 1] AS cy FROM part, range(4) t(e)), placed AS (SELECT *, bx + cx * w AS x0, by_ + cy * h AS y0, CAST(CASE WHEN edge % 2 = 0 THEN w ELSE h END AS DOUBLE) AS len, bx + w / 2.0::DOUBLE + nx * w / 2.0::DOUBLE AS mx, by_ + h / 2.0::DOUBLE + ny * h / 2.0::DOUBLE AS my FROM sides)"""


def _hits_sql(pixels: str) -> str:
    return f"""WITH {DEM_SQL}, pix AS ({pixels}), samples AS (SELECT eye, px, py, ez, slope, k, -(ey + uy * k) - 0.5::DOUBLE AS rf, ex + ux * k - 0.5::DOUBLE AS cf FROM eyes, pix, (SELECT CAST(unnest(range(1, 21)) AS DOUBLE) AS k)
    ), f AS (SELECT eye, px, py, k, ((z00 * (1 - (cf - c)) + z01 * (cf - c)) * (1 - (rf - r)) + (z10 * (1 - (cf - c)) + z11 * (cf - c)) * (rf - r)) - (ez + slope * k) AS f
      FROM samples JOIN four ON four.r = CAST(floor(rf) AS INTEGER) AND four.c = CAST(floor(cf) AS INTEGER)
    ), hit AS (SELECT eye, px, py, min(k) AS k, arg_min(f, k) AS f FROM f WHERE f >= 0 GROUP BY ALL
    ), prev AS (SELECT eye, px, py, arg_max(f.f, f.k) AS p FROM f JOIN hit USING (eye, px, py) WHERE f.k < hit.k GROUP BY ALL
    ), put AS (SELECT eye, px, py, k, f, coalesce(p, -1.6::DOUBLE) AS p FROM hit LEFT JOIN prev USING (eye, px, py))
    SELECT e.eye, d.px, d.py, {_MM('k - 1 + CASE WHEN abs(p - f) > 1e-9 THEN greatest(0.0, least(1.0, p / (p - f))) ELSE 1.0 END')} AS hit_mm FROM eyes e CROSS JOIN pix d LEFT JOIN put USING (eye, px, py)"""


def _camera_sql() -> str:
    f, r, u = ry.basis(*VIEW[:2])
    return ", ".join(f"dx * {a[0]!r}::DOUBLE + dy * {a[1]!r}::DOUBLE + dz * {a[2]!r}::DOUBLE AS {n}" for a, n in zip((f, r, u), ("f", "r", "u")))


ORACLES = {
    "opening_axes": f"""WITH {SIDES_SQL}, o AS (SELECT *, CAST(j - 1 AS INTEGER) AS n, len * j / (id % 3 + 2) AS s, id % 4 * 0.1::DOUBLE + 0.2::DOUBLE AS th, CASE WHEN id % 5 > 0 THEN least(id % 9 * 0.05::DOUBLE, 0.6::DOUBLE * (id % 4 * 0.1::DOUBLE + 0.2::DOUBLE)) END AS depth, id % 4 * 0.5::DOUBLE + 0.5::DOUBLE AS z1 FROM placed, range(1, 4) q(j) WHERE edge = id % 4 AND j <= id % 3 + 1),
      c AS (SELECT *, x0 + ux * s AS ox, y0 + uy * s AS oy, id % 3 + 1 AS bx3, id % 5 + 1 AS by3, id % 2 AS bz3 FROM o WHERE z1 > 0.5)
      SELECT id, n, {_MM('ox + nx * 1.5::DOUBLE')} AS ex_mm, {_MM('oy + ny * 1.5::DOUBLE')} AS ey_mm, {_MM('id % 7 + 1.5::DOUBLE')} AS ez_mm, {_MM('ox')} AS cx_mm, {_MM('oy')} AS cy_mm, {_MM('(0.5::DOUBLE + z1) / 2')} AS cz_mm, {_MM('depth')} AS depth_mm,
        CASE WHEN depth > 0 THEN {_MM('ox - nx * (th - depth / 2)')} END AS px_mm, CASE WHEN depth > 0 THEN {_MM('oy - ny * (th - depth / 2)')} END AS py_mm, {_MM('degrees(acos(greatest(-1.0, least(1.0, -(nx * bx3 + ny * by3) / sqrt(CAST(bx3 * bx3 + by3 * by3 + bz3 * bz3 AS DOUBLE))))))')} AS off_e3 FROM c""",
    "anchors_resolved": f"""WITH {SIDES_SQL}, a AS (SELECT id, (edge + 1) % 4 AS wall, CASE WHEN id % 7 > 0 THEN [180, 90, 0, 270][edge + 1] END AS az, mx + id % 6 * 0.75::DOUBLE AS ax, my + 0.125::DOUBLE AS ay FROM placed WHERE edge = id % 4),
      m AS (SELECT a.id, p.edge, sqrt((round_even(p.mx, 2) - ax) * (round_even(p.mx, 2) - ax) + (round_even(p.my, 2) - ay) * (round_even(p.my, 2) - ay)) AS d, [180, 90, 0, 270][p.edge + 1] = az AND sqrt((round_even(p.mx, 2) - ax) * (round_even(p.mx, 2) - ax) + (round_even(p.my, 2) - ay) * (round_even(p.my, 2) - ay)) <= 0.5 AS exact FROM a JOIN placed p ON p.id = a.id WHERE az IS NOT NULL),
      b AS (SELECT * FROM m WHERE exact OR d <= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY NOT exact, d, edge) = 1)
      SELECT a.id, CASE WHEN az IS NULL THEN a.wall ELSE b.edge END AS edge, CASE WHEN az IS NULL THEN 'unanchored' WHEN exact THEN 'matched' WHEN b.id IS NOT NULL THEN 'drifted' ELSE 'lost' END AS status FROM a LEFT JOIN b USING (id)""",
    "facing_walls": "SELECT p_partkey AS id, CAST(p_partkey % 4 AS INTEGER) AS door, CAST((p_partkey + 2) % 4 AS INTEGER) AS facing FROM part",
    "marks_in_frame": f"""WITH {DEM_SQL}, l AS (SELECT a.eye, b.eye AS other, b.ex - a.ex AS dx, b.ey - a.ey AS dy, b.ez - a.ez AS dz FROM eyes a JOIN eyes b ON a.eye <> b.eye AND (b.ex - a.ex) * (b.ex - a.ex) + (b.ey - a.ey) * (b.ey - a.ey) <= 144), d AS (SELECT eye, other, {_camera_sql()} FROM l),
      p AS (SELECT eye, other, (r / f / tan(radians(35)) + 1) / 2 * 64 AS x, (1 - u / f / tan(radians(35)) / 0.75::DOUBLE) / 2 * 48 AS y FROM d WHERE f > 0) SELECT eye, other, {_MM('x')} AS x_e3, {_MM('y')} AS y_e3 FROM p WHERE x >= 0 AND x < 64 AND y >= 0 AND y < 48""",
    "panorama_hits": _hits_sql("SELECT px, py, sin(radians(-180 + (px + 0.5) * 30)) AS ux, cos(radians(-180 + (px + 0.5) * 30)) AS uy, tan(radians(greatest(-85.0::DOUBLE, least(85.0::DOUBLE, 52.5::DOUBLE - (py + 0.5) * 30)))) AS slope FROM range(12) a(px), range(4) b(py)"),
    "picture_hits": _hits_sql(f"""SELECT px, py, dx / flat AS ux, dy / flat AS uy, greatest(-tan(radians(85)), least(tan(radians(85)), dz / flat)) AS slope FROM (SELECT *, sqrt(dx * dx + dy * dy) AS flat FROM (SELECT px, py, {', '.join(f"{f!r}::DOUBLE + a * tan(radians(35)) * ({r!r}::DOUBLE) + b * tan(radians(35)) * ({u!r}::DOUBLE) AS d{n}" for f, r, u, n in zip(*ry.basis(*VIEW[:2]), "xyz"))}
      FROM (SELECT px, py, (px + 0.5::DOUBLE) / 8 * 2 - 1 AS a, (1 - (py + 0.5::DOUBLE) / 6 * 2) * 0.75::DOUBLE AS b FROM range(8) x(px), range(6) y(py))))"""),
    "largest_parts": """WITH r AS (SELECT p_partkey AS id, CAST(j AS INTEGER) AS part, (p_partkey * (j + 3) % 7 + 1) * (p_partkey * (j + 3) % 5 + 1) AS area FROM part, range(4) t(j) WHERE j <= p_partkey % 3 + 1)
      SELECT id, part, area, array_to_string(list_transform(range(1, least(8, id % 12 + 1) + 1), lambda j: id * 3 + j), '|') AS names FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY area DESC, part) = 1""",
    "door_envelopes": f"""WITH {DEM_SQL}, s AS (SELECT eye AS scene, ex AS x, ey AS y, ez - 1.6::DOUBLE AS fl, rg, an, ex + rg * sin(radians(an)) AS sx, ey - rg * cos(radians(an)) AS sy FROM eyes, (SELECT unnest([3.0::DOUBLE, 5, 8]) AS rg), (SELECT unnest([-60.0::DOUBLE, -30, 0, 30, 60]) AS an)),
      gr AS (SELECT scene, x, y, fl, rg, an, sx, sy, (z00 * (1 - wc) + z01 * wc) * (1 - wr) + (z10 * (1 - wc) + z11 * wc) * wr AS gz FROM (SELECT *, -sy - 0.5 - floor(-sy - 0.5) AS wr, sx - 0.5 - floor(sx - 0.5) AS wc FROM s) LEFT JOIN four ON r = CAST(floor(-sy - 0.5) AS INTEGER) AND c = CAST(floor(sx - 0.5) AS INTEGER)),
      look AS (SELECT scene, rg, an, t, sx AS ex, sy AS ey, gz + 1.6::DOUBLE AS ez, x + [-0.75::DOUBLE, 0.75::DOUBLE][t % 2 + 1] AS tx, y + 0.25::DOUBLE AS ty, fl + CASE WHEN t < 2 THEN 0.5::DOUBLE ELSE 2.5::DOUBLE END AS tz FROM gr, range(4) q(t) WHERE gz IS NOT NULL), {los_sql('look', 'scene, rg, an, t')},
      sums AS (SELECT scene, rg, an, count(*) FILTER (visible) AS seen, max(degrees(acos(least(1.0, (ty - ey) / sqrt((tx - ex) * (tx - ex) + (ty - ey) * (ty - ey)))))) FILTER (visible) AS widest FROM seen GROUP BY ALL)
      SELECT s.scene, s.rg AS range, s.an AS angle, seen, {_MM('widest')} AS widest_e3 FROM s LEFT JOIN sums ON sums.scene = s.scene AND sums.rg = s.rg AND sums.an = s.an""",
}
