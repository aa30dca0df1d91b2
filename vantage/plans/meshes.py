"""Queries of the mesh, volume and label operators.

Buildings are one for each part, on a lattice four apart, so a segment meets few of them
however many there are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import mesh as ms
from vantage.operators import labels as lb
from vantage.session import table

from .scenes import DEM_SQL, dem

ACROSS = 50


def buildings(spark, sf_dir):
    """id, x0, y0, x1, y1, top of each part's box."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k % ACROSS * 4).cast("double"), (F.floor(k / ACROSS) * 4).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 1 + s % 3).alias("x1"), (y0 + 1 + s % 2).alias("y1"), (s % 5 + 1).cast("double").alias("top"))


def triangles(spark, sf_dir):
    return ms.box_triangles(buildings(spark, sf_dir), F.lit(0.0), F.col("top"))


def segments(spark, sf_dir):
    """A segment for each order, some metres over a few buildings."""
    k = F.col("o_orderkey")
    ex, ey, ez = k * 7 % 199 + 0.37, k * 13 % 161 + 0.61, k % 6 * 0.9 + 0.23
    return table(spark, sf_dir, "orders").select("o_orderkey", ex.cast("double").alias("ex"), ey.cast("double").alias("ey"), ez.cast("double").alias("ez"), (ex + k % 9 - 3.81).cast("double").alias("tx"), (ey + k % 7 - 2.73).cast("double").alias("ty"), (ez + k % 3 * 0.5 - 0.47).cast("double").alias("tz"))


def triangle_blocked(spark, sf_dir):
    """Orders whose segment a building blocks."""
    return ms.blocked(segments(spark, sf_dir), triangles(spark, sf_dir), ["o_orderkey"])


def triangle_first_hit(spark, sf_dir):
    """How far along its segment each order meets a building first, in parts per million."""
    hit = ms.mesh_first_hit(segments(spark, sf_dir), triangles(spark, sf_dir), ["o_orderkey"])
    return hit.select("o_orderkey", F.rint(F.col("t") * 1e6).cast("long").alias("t_e6"))


def crosses_opening(spark, sf_dir):
    """Orders whose segment passes the door in the south wall of their building."""
    s = segments(spark, sf_dir).select("o_orderkey", "ex", "ey", "ez", "tx", "ty", "tz")
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 * 0.1).cast("double").alias("thickness"))
    n = F.pmod(F.col("o_orderkey") * 37, F.lit(w.count())) + 1
    walls = s.withColumn("id", n).join(w, "id").withColumns({"wx": F.col("ex") - 2.0, "wy": F.col("ey") + 0.4, "ux": F.lit(1.0), "uy": F.lit(0.0), "s0": F.lit(0.5), "s1": F.lit(3.0), "z0": F.lit(0.0), "z1": F.lit(2.2)})
    return walls.where(ms.crosses_opening()).select("o_orderkey")


def mesh_measures(spark, sf_dir):
    """Triangles, area and volume (about their centre) of each building's shell, in thousandths."""
    out = ms.measures(triangles(spark, sf_dir))
    return out.select("bid", "n", *(F.rint(F.col(c) * 1000).cast("long").alias(f"{c}_e3") for c in ("area", "volume")))


def edge_parity(spark, sf_dir):
    """Edges of each building's shell; the open ones are those of the missing floor, and of the walls that every third building lacks."""
    return ms.open_edges(triangles(spark, sf_dir).where("bid % 3 > 0 OR tri >= 2 * (bid % 4)"))


def _voxels(spark, sf_dir):
    heights = dem(spark, sf_dir).where("z IS NOT NULL")
    return heights.select("r", "c", F.explode(F.sequence(F.lit(1), F.col("z").cast("int"))).alias("l"))


def voxel_boundary(spark, sf_dir):
    """Faces of the solid under the grid by level and direction."""
    return ms.voxel_faces(_voxels(spark, sf_dir)).groupBy("l", "axis", "side").agg(F.count("*").alias("n"))


def blob_labels(spark, sf_dir):
    """Four-connected blobs of the grid's highest cells: smallest cell and size."""
    cells = dem(spark, sf_dir).where("z >= 7").select("r", "c")
    return lb.label_cells(cells, 64).groupBy("label").agg(F.count("*").alias("n"))


def _faces_sql() -> str:
    quads = [("x0,y0,0", "x1,y0,0", "x1,y0,top", "x0,y0,top"), ("x1,y0,0", "x1,y1,0", "x1,y1,top", "x1,y0,top"), ("x1,y1,0", "x0,y1,0", "x0,y1,top", "x1,y1,top"), ("x0,y1,0", "x0,y0,0", "x0,y0,top", "x0,y1,top"), ("x0,y0,top", "x1,y0,top", "x1,y1,top", "x0,y1,top")]
    rows = []
    for i, quad in enumerate(quads):
        for j in (0, 1):
            cells = ", ".join(f"CAST({v} AS DOUBLE) AS {p}{k}" for p, point in zip("abc", (quad[0], quad[1 + j], quad[2 + j])) for k, v in zip("xyz", point.split(",")))
            rows.append(f"SELECT id AS bid, {2 * i + j} AS tri, {cells} FROM b")
    return " UNION ALL ".join(rows)


B_SQL = f"""b AS (SELECT p_partkey AS id, CAST(p_partkey % {ACROSS} * 4 AS DOUBLE) AS x0, CAST(p_partkey // {ACROSS} * 4 AS DOUBLE) AS y0, CAST(p_partkey % {ACROSS} * 4 + 1 + p_size % 3 AS DOUBLE) AS x1,
  CAST(p_partkey // {ACROSS} * 4 + 1 + p_size % 2 AS DOUBLE) AS y1, CAST(p_size % 5 + 1 AS DOUBLE) AS top FROM part), tri AS ({_faces_sql()})"""
SEG_SQL = """e AS (SELECT o_orderkey AS k, CAST(o_orderkey * 7 % 199 + 0.37::DOUBLE AS DOUBLE) AS ex, CAST(o_orderkey * 13 % 161 + 0.61::DOUBLE AS DOUBLE) AS ey, CAST(o_orderkey % 6 * 0.9::DOUBLE + 0.23::DOUBLE AS DOUBLE) AS ez FROM orders),
  seg AS (SELECT *, ex + k % 9 - 3.81::DOUBLE AS tx, ey + k % 7 - 2.73::DOUBLE AS ty, ez + k % 3 * 0.5::DOUBLE - 0.47::DOUBLE AS tz FROM e)"""
HITS_SQL = f"""WITH {B_SQL}, {SEG_SQL}, near AS (SELECT k, ex, ey, ez, tx - ex AS dx, ty - ey AS dy, tz - ez AS dz, id FROM seg JOIN b
    ON greatest(ex, tx) >= x0 AND least(ex, tx) <= x1 AND greatest(ey, ty) >= y0 AND least(ey, ty) <= y1 AND least(ez, tz) <= top AND greatest(ez, tz) >= 0),
  v AS (SELECT k, dx, dy, dz, bx - ax AS ux, b.by - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, ex - ax AS sx, ey - ay AS sy, ez - az AS sz FROM near JOIN tri b ON b.bid = id),
  p AS (SELECT *, dy * vz - dz * vy AS px, dz * vx - dx * vz AS py, dx * vy - dy * vx AS pz, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM v),
  d AS (SELECT *, ux * px + uy * py + uz * pz AS det FROM p),
  h AS (SELECT k, sqrt(dx * dx + dy * dy + dz * dz) AS len, (sx * px + sy * py + sz * pz) / det AS u, (dx * qx + dy * qy + dz * qz) / det AS w, (vx * qx + vy * qy + vz * qz) / det AS t FROM d WHERE abs(det) > 1e-9),
  hits AS (SELECT * FROM h WHERE u >= -1e-6 AND w >= -1e-6 AND u + w <= 1 + 1e-6)"""

QUERIES = {f.__name__: f for f in (triangle_blocked, triangle_first_hit, crosses_opening, mesh_measures, edge_parity, voxel_boundary, blob_labels)}
ORACLES = {
    "triangle_blocked": f"{HITS_SQL} SELECT DISTINCT k AS o_orderkey FROM hits WHERE t * len > 0 AND t * len < len - 0.05",
    "triangle_first_hit": f"{HITS_SQL} SELECT k AS o_orderkey, CAST(round_even(min(t) * 1e6, 0) AS BIGINT) AS t_e6 FROM hits WHERE t > 0 AND t < 1 GROUP BY k",
    "crosses_opening": f"""WITH {SEG_SQL}, w AS (SELECT k, ex, ey, ez, tx, ty, tz, ex - 2 AS wx, ey + 0.4::DOUBLE AS wy, p_size % 4 * 0.1::DOUBLE AS th FROM seg JOIN part ON p_partkey = k * 37 % (SELECT count(*) FROM part) + 1),
      o AS (SELECT *, (ey - wy) / nullif((ey - wy) - (ty - wy), 0) AS t0, (ey - wy - th) / nullif((ey - wy - th) - (ty - wy - th), 0) AS t1 FROM w)
      SELECT k AS o_orderkey FROM o WHERE t0 > 0 AND t0 < 1 AND ex + t0 * (tx - ex) - wx BETWEEN 0.5 AND 3.0 AND ez + t0 * (tz - ez) BETWEEN 0 AND 2.2::DOUBLE
      AND (th <= 0 OR (t1 > 0 AND t1 < 1 AND ex + t1 * (tx - ex) - wx BETWEEN 0.5 AND 3.0 AND ez + t1 * (tz - ez) BETWEEN 0 AND 2.2::DOUBLE))""",
    "mesh_measures": f"""WITH {B_SQL} SELECT id AS bid, CAST(10 AS BIGINT) AS n, CAST(round_even(((x1 - x0) * (y1 - y0) + 2 * top * (x1 - x0 + y1 - y0)) * 1000, 0) AS BIGINT) AS area_e3,
      CAST(round_even((x1 - x0) * (y1 - y0) * top * 0.8::DOUBLE * 1000, 0) AS BIGINT) AS volume_e3 FROM b""",
    "edge_parity": f"""WITH {B_SQL}, e AS (SELECT bid, unnest([[ax, ay, az], [bx, "by", bz], [cx, cy, cz]]) AS p, unnest([[bx, "by", bz], [cx, cy, cz], [ax, ay, az]]) AS q FROM tri WHERE bid % 3 > 0 OR tri >= 2 * (bid % 4)),
      n AS (SELECT bid, least(p, q) AS a, greatest(p, q) AS b, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT bid, count(*) AS edges, count(*) FILTER (n = 1) AS open, count(*) FILTER (n % 2 = 1) AS odd FROM n GROUP BY bid""",
    "voxel_boundary": f"""WITH {DEM_SQL}, v AS (SELECT r, c, unnest(range(1, CAST(z AS BIGINT) + 1)) AS l FROM dem WHERE z IS NOT NULL), d AS (SELECT * FROM (VALUES ('r', -1, -1, 0, 0), ('r', 1, 1, 0, 0), ('c', -1, 0, -1, 0), ('c', 1, 0, 1, 0), ('l', -1, 0, 0, -1), ('l', 1, 0, 0, 1)) d(axis, side, dr, dc, dl))
      SELECT CAST(v.l AS INTEGER) AS l, axis, side, count(*) AS n FROM v CROSS JOIN d LEFT JOIN v o ON o.r = v.r + dr AND o.c = v.c + dc AND o.l = v.l + dl WHERE o.r IS NULL GROUP BY 1, 2, 3""",
    "blob_labels": f"""WITH RECURSIVE {DEM_SQL}, k AS (SELECT r, c, r * 64 + c AS i FROM dem WHERE z >= 7), reach AS (
        SELECT i AS root, r, c FROM k UNION SELECT root, k.r, k.c FROM reach JOIN k ON abs(k.r - reach.r) + abs(k.c - reach.c) = 1 AND true)
      SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM (SELECT r, c, min(root) AS label FROM reach GROUP BY r, c) GROUP BY label""",
}
