"""Queries of scene variants: buildings as blocks, as closed shells, with openings, and all three with domes."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import variants as vr
from vantage.operators import visibility as v
from vantage.operators.scratch import kept
from vantage.session import table

from .scenes import CELL_RAYS_SQL, DEM_SQL, GRID, dem, eyes, los_sql

WIDE, DEEP, CAP = 2.53, 1.91, 1.5
JAMB, LINTEL = (0.9, 1.7), 1.0
#: The first is the scene from which the others differ.
VARIANTS = {
    "doorless": ("ground", ("sides", "ends")),
    "doorless, domes": ("ground", ("sides", "ends", "domes")),
    "apertured": ("ground", ("sides", "open")),
    "apertured, domes": ("ground", ("sides", "open", "domes")),
    "bare": ("blocks", ()),
    "bare, domes": ("domed", ()),
}


def _houses(spark, sf_dir):
    """id, x0, y0, x1, y1, top: a building in each 8 x 8 block of the grid that a part stands in, as tall as the tallest part's."""
    k = F.col("p_partkey")
    spot = table(spark, sf_dir, "part").select((k % 8).alias("i"), (F.floor(k / 8) % 8).alias("j"), F.col("p_size").alias("s")).groupBy("i", "j").agg(F.max("s").alias("s"))
    x0, y0 = F.col("i") * 8 + 3.27, -(F.col("j") * 8) - 5.737
    out = spot.select((F.col("i") * 8 + F.col("j")).alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + WIDE).alias("x1"), (y0 + DEEP).alias("y1"), (F.col("s") % 6 + 4.3).alias("top"))
    return out.select("id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "top")))


def _parts(houses):
    """The houses' triangles: sides and roof, ends, ends with a doorway, and caps."""
    x0, y0, x1, y1, top = (F.col(c) for c in ("x0", "y0", "x1", "y1", "top"))
    zero = F.lit(0.0)
    upright = lambda a, b, y, lo, hi: ((a, y, lo), (b, y, lo), (b, y, hi), (a, y, hi))
    side = lambda x: ((x, y0, zero), (x, y1, zero), (x, y1, top), (x, y0, top))
    d0, d1, peak = x0 + JAMB[0], x0 + JAMB[1], ((x0 + x1) / 2, (y0 + y1) / 2, top + CAP)
    quads = {"sides": [side(x0), side(x1), ((x0, y0, top), (x1, y0, top), (x1, y1, top), (x0, y1, top))], "ends": [upright(x0, x1, y, zero, top) for y in (y0, y1)]}
    quads["open"] = [q for y in (y0, y1) for q in (upright(x0, d0, y, zero, top), upright(d1, x1, y, zero, top), upright(d0, d1, y, top - LINTEL, top))]
    base = [(x0, y0, top), (x1, y0, top), (x1, y1, top), (x0, y1, top)]
    tris = [(p, t) for p, some in quads.items() for a, b, c, d in some for t in ((a, b, c), (a, c, d))] + [("domes", (base[i], base[(i + 1) % 4], peak)) for i in range(4)]
    rows = [F.struct(F.lit(p).alias("part"), F.lit(i).alias("tri"), *(c.cast("double").alias(n + k) for n, corner in zip("abc", t) for k, c in zip("xyz", corner))) for i, (p, t) in enumerate(tris)]
    return houses.select(F.col("id").alias("bid"), F.explode(F.array(*rows)).alias("t")).select("bid", "t.*")


def scene(spark, sf_dir):
    """rays, surfaces and parts of the variants."""
    heights = dem(spark, sf_dir)
    houses = kept(_houses(spark, sf_dir))
    x, y = GRID.x(F.col("c").cast("double")), GRID.y(F.col("r").cast("double"))
    cells = lambda k, n: F.explode(F.sequence(F.floor(n[0]).cast("int"), F.floor(n[1]).cast("int"))).alias(k)
    under = houses.select("*", cells("c", (F.col("x0"), F.col("x1")))).select("*", cells("r", (-F.col("y1"), -F.col("y0"))))
    under = under.where((x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))).select("r", "c", "top")
    raised = lambda up: kept(heights.join(under, ["r", "c"], "left").select("r", "c", F.when(F.col("z").isNotNull(), F.greatest("z", F.col("top") + up)).alias("z")))
    rays = v.eye_cells(eyes(spark, sf_dir, heights), heights.where("z IS NOT NULL"), GRID, 8.0).select("eye", "r", "c", "ex", "ey", "ez", "tx", "ty", "tz")
    return rays, {"ground": heights, "blocks": raised(0.0), "domed": raised(CAP)}, kept(_parts(houses))


def variant_shares(spark, sf_dir):
    """How many cells each observer sees in each variant of the scene."""
    rays, surfaces, parts = scene(spark, sf_dir)
    seen = vr.variant_sights(rays, ["eye", "r", "c"], GRID, surfaces, parts, VARIANTS)
    return seen.groupBy("variant", "eye").agg(F.count_if("visible").alias("n_seen"), F.count("*").alias("n"))


def _four_sql(dem_name: str, out: str) -> str:
    return f"""{out} AS (SELECT a.r, a.c, a.z AS z00, b.z AS z01, d.z AS z10, e.z AS z11 FROM {dem_name} a JOIN {dem_name} b ON b.r = a.r AND b.c = a.c + 1 JOIN {dem_name} d ON d.r = a.r + 1 AND d.c = a.c
      JOIN {dem_name} e ON e.r = a.r + 1 AND e.c = a.c + 1 WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND d.z IS NOT NULL AND e.z IS NOT NULL)"""


def _raised_sql(out: str, up: float) -> str:
    return f"""{out} AS (SELECT r, c, CASE WHEN z IS NOT NULL THEN greatest(z, (SELECT max(top) + {up}::DOUBLE FROM h WHERE c + 0.5::DOUBLE >= x0 AND c + 0.5::DOUBLE < x1 AND -(r + 0.5::DOUBLE) >= y0 AND -(r + 0.5::DOUBLE) < y1)) END AS z FROM dem)"""


def _shares_sql() -> str:
    """All rays in all variants: flat walls met by their planes, caps as the lowest of four slopes."""
    rects = []
    for part, axis, at, u, z in (("sides", "x", "x0", ("y0", "y1"), ("0", "top")), ("sides", "x", "x1", ("y0", "y1"), ("0", "top")), *(("ends", "y", y, ("x0", "x1"), ("0", "top")) for y in ("y0", "y1"))):
        rects.append((part, axis, at, u, z))
    for y in ("y0", "y1"):
        rects += [("open", "y", y, ("x0", f"x0 + {JAMB[0]}"), ("0", "top")), ("open", "y", y, (f"x0 + {JAMB[1]}", "x1"), ("0", "top")), ("open", "y", y, (f"x0 + {JAMB[0]}", f"x0 + {JAMB[1]}"), (f"top - {LINTEL}", "top"))]
    hits = []
    for part, axis, at, (lo, hi), (zl, zh) in rects:
        other = "y" if axis == "x" else "x"
        t = f"({at} - e{axis}) / nullif(t{axis} - e{axis}, 0)"
        hits.append(f"SELECT eye, r, c, '{part}' AS part, len, {t} AS t FROM near WHERE e{other} + (t{other} - e{other}) * {t} BETWEEN {lo} AND {hi} AND ez + (tz - ez) * {t} BETWEEN {zl} AND {zh}")
    hits.append("SELECT eye, r, c, 'sides', len, (top - ez) / nullif(tz - ez, 0) FROM near WHERE ex + (tx - ex) * (top - ez) / nullif(tz - ez, 0) BETWEEN x0 AND x1 AND ey + (ty - ey) * (top - ez) / nullif(tz - ez, 0) BETWEEN y0 AND y1")
    slope = {"(x - x0)": ("ex - x0", "tx - ex", WIDE), "(x1 - x)": ("x1 - ex", "ex - tx", WIDE), "(y - y0)": ("ey - y0", "ty - ey", DEEP), "(y1 - y)": ("y1 - ey", "ey - ty", DEEP)}
    g = lambda k, t: f"((({slope[k][0]}) + ({slope[k][1]}) * ({t})) * {2 * CAP / slope[k][2]!r}::DOUBLE)"
    for k, (a, d, size) in slope.items():
        m = f"{2 * CAP / size!r}::DOUBLE"
        t = f"(({a}) * {m} - (ez - top)) / nullif((tz - ez) - ({d}) * {m}, 0)"
        hits.append(f"SELECT eye, r, c, 'domes', len, t FROM (SELECT *, {t} AS t FROM near) WHERE {g(k, 't')} >= -1e-9 AND " + " AND ".join(f"{g(o, 't')} >= {g(k, 't')} - 1e-9" for o in slope if o != k))
    cases = " UNION ALL ".join(f"SELECT '{n}' AS variant, '{s}' AS surface, {list(p)!r}::VARCHAR[] AS parts" for n, (s, p) in VARIANTS.items())
    marches = ", ".join(los_sql("low", "eye, r, c", f"_{s}").replace("FROM four)", f"FROM four_{s})") for s in ("ground", "blocks", "domed"))
    seen = " UNION ALL ".join(f"SELECT '{s}' AS surface, eye, r, c, visible FROM seen_{s}" for s in ("ground", "blocks", "domed"))
    return f"""WITH {DEM_SQL}, {CELL_RAYS_SQL}, low AS (SELECT * FROM rays WHERE tz IS NOT NULL),
      h AS (SELECT i * 8 + 3.27::DOUBLE AS x0, -(j * 8) - 5.737::DOUBLE AS y0, i * 8 + 3.27::DOUBLE + {WIDE}::DOUBLE AS x1, -(j * 8) - 5.737::DOUBLE + {DEEP}::DOUBLE AS y1, s % 6 + 4.3::DOUBLE AS top
        FROM (SELECT p_partkey % 8 AS i, p_partkey // 8 % 8 AS j, max(p_size) AS s FROM part GROUP BY 1, 2)),
      {_raised_sql('up_blocks', 0.0)}, {_raised_sql('up_domed', CAP)}, {_four_sql('dem', 'four_ground')}, {_four_sql('up_blocks', 'four_blocks')}, {_four_sql('up_domed', 'four_domed')}, {marches},
      near AS (SELECT l.*, h.*, sqrt((tx - ex) * (tx - ex) + (ty - ey) * (ty - ey) + (tz - ez) * (tz - ez)) AS len FROM low l JOIN h ON greatest(ex, tx) >= x0 AND least(ex, tx) <= x1 AND greatest(ey, ty) >= y0 AND least(ey, ty) <= y1),
      hits AS ({' UNION ALL '.join(hits)}), cuts AS (SELECT eye, r, c, list(DISTINCT part) AS met FROM hits WHERE t * len > 0 AND t * len < len - 0.05 GROUP BY ALL), cases AS ({cases}), sights AS ({seen})
      SELECT variant, eye, count(*) FILTER (visible AND NOT coalesce(list_has_any(parts, met), false)) AS n_seen, count(*) AS n FROM sights JOIN cases USING (surface) LEFT JOIN cuts USING (eye, r, c) GROUP BY variant, eye"""


QUERIES = {f.__name__: f for f in (variant_shares,)}
ORACLES = {"variant_shares": _shares_sql()}
