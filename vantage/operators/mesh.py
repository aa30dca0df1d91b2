"""Triangles: ray hits, blocked segments, areas, volumes, open edges, voxel faces.

Triangles are rows (bid, tri, ax..cz). Rays and the boxes of buildings are dealt to the
tiles that they reach, a tile's rays meet its triangles as arrays in a task, and a hit is
a minimum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import numbered
from .scratch import kept, shuffled
from .surface import blocks

#: Segments of a tile that one task takes, about; pairs of segments and boxes, or triangles, that it holds at once; tiles that are sent to all executors.
PER_TASK, PAIRS, FEW_TILES = 1 << 16, 1 << 18, 100_000
EPS_DET, EPS_BARY, BACK = 1e-9, 1e-6, 0.05


def _cross(a: tuple, b: tuple) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _corner(p: str) -> tuple:
    return tuple(F.col(p + k) for k in "xyz")


def _minus(a: tuple, b: tuple) -> tuple:
    return tuple(x - y for x, y in zip(a, b))


def hit_t(origin: tuple, direction: tuple, corners: tuple) -> np.ndarray:
    """Ray parameters at which triangles are met from either side, NaN where they aren't. Points are arrays x, y, z."""
    a, b, c = corners
    e1, e2 = _minus(b, a), _minus(c, a)
    p = _cross(direction, e2)
    det = _dot(e1, p)
    s = _minus(origin, a)
    q = _cross(s, e1)
    safe = np.where(np.abs(det) > EPS_DET, det, np.nan)
    u, v, t = _dot(s, p) / safe, _dot(direction, q) / safe, _dot(e2, q) / safe
    return np.where((u >= -EPS_BARY) & (v >= -EPS_BARY) & (u + v <= 1 + EPS_BARY), t, np.nan)


def boxes(triangles: DataFrame, by: list[str] | None = None, *more: Column) -> DataFrame:
    """Each building's bounding box (or that of each group of its triangles), and more sums."""
    low = lambda k: F.min(F.least(f"a{k}", f"b{k}", f"c{k}")).alias(f"lo_{k}")
    high = lambda k: F.max(F.greatest(f"a{k}", f"b{k}", f"c{k}")).alias(f"hi_{k}")
    return triangles.groupBy(*(by or ["bid"])).agg(*(f(k) for k in "xyz" for f in (low, high)), *more)


def _dealt(segments: DataFrame, box: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments and boxes of the tiles that both have, with _share: a tile of many segments is dealt to several tasks, its boxes go to all of them."""
    load = kept(segments.groupBy(*by).agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("_shares")).join(shuffled(box.select(*by).distinct()), by, "left_semi"))
    load = F.broadcast(load) if load.count() <= FEW_TILES else shuffled(load)
    thrown = segments.join(load, by).withColumn("_share", F.pmod(F.xxhash64("ex", "ey", "ez", "tx", "ty", "tz"), F.col("_shares")).cast("int")).drop("_shares")
    return thrown, box.join(load, by).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")


def nearest_hits(segments: DataFrame, triangles: DataFrame, keys: list[str], tile: float, counts: Callable[[np.ndarray, np.ndarray], np.ndarray], within: tuple[str, ...] = ()) -> DataFrame:
    """Keys and t, the smallest ray parameter at which a segment (keys, ex..ez, tx..tz) meets a triangle, of those that count: counts(parameter, segment's length). Both carry the columns within, and only equal ones meet.

    A building's triangles are boxed by the tile of their centre, so a box is small
    however large the building, and they travel with it. Box and segment meet by tiles,
    and a pair counts in the first tile that both have: no pair comes twice. In a tile all
    segments are held against all boxes at once, and then against the triangles of those
    that theirs meets, some at a time.
    """
    own = list(within)
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / tile), F.floor(F.greatest(a, b) / tile))
    centre = lambda k: F.floor((F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / (3 * tile))
    corners = [p + k for p in "abc" for k in "xyz"]
    ends, sides = [p + k for p in "et" for k in "xyz"], [p + k for k in "xyz" for p in ("lo_", "hi_")]
    box = boxes(triangles.withColumns({"_cx": centre("x"), "_cy": centre("y")}), [*own, "bid", "_cx", "_cy"], F.collect_list(F.array(*(F.col(c).cast("double") for c in corners))).alias("_tris"))
    box = box.withColumn("gx", F.explode(span("lo_x", "hi_x"))).withColumn("gy", F.explode(span("lo_y", "hi_y"))).select(*own, "gx", "gy", *(F.col(c).cast("double").alias(c) for c in sides), "_tris")
    names = list(dict.fromkeys([*keys, *own]))
    seg = segments.select(*names, *(F.col(c).cast("double").alias(c) for c in ends)).withColumn("gx", F.explode(span("ex", "tx"))).withColumn("gy", F.explode(span("ey", "ty")))
    by = [*own, "gx", "gy"]
    thrown, there = _dealt(seg, box, by)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        e, t = ([left.column(p + k).to_numpy() for k in "xyz"] for p in "et")
        best = np.full(left.num_rows, np.nan)
        if left.num_rows and right.num_rows:
            low, high = ([right.column(p + k).to_numpy() for k in "xyz"] for p in ("lo_", "hi_"))
            lists = right.column("_tris").combine_chunks()
            begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            corner = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
            here = {"x": left.column("gx")[0].as_py(), "y": left.column("gy")[0].as_py()}
            d = _minus(t, e)
            length = np.sqrt(_dot(d, d))
            first = [np.floor(np.minimum(e[k], t[k]) / tile) for k in (0, 1)]
            step = max(1, PAIRS // right.num_rows)
            for at in range(0, left.num_rows, step):
                part = slice(at, at + step)
                meets = np.ones((len(best[part]), right.num_rows), bool)
                for k in range(3):
                    meets &= (np.maximum(e[k][part], t[k][part])[:, None] >= low[k]) & (np.minimum(e[k][part], t[k][part])[:, None] <= high[k])
                for k, axis in enumerate("xy"):
                    meets &= np.maximum(first[k][part][:, None], np.floor(low[k] / tile)) == here[axis]
                ray, which = np.nonzero(meets)
                for few in blocks(begin[which + 1] - begin[which], PAIRS):
                    n = begin[which[few] + 1] - begin[which[few]]
                    each = np.repeat(ray[few] + at, n)
                    tri = corner[np.repeat(begin[which[few]], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        met = hit_t(tuple(c[each] for c in e), tuple(c[each] for c in d), tuple(tuple(tri[:, p, k] for k in range(3)) for p in range(3)))
                        fine = counts(met, length[each])
                    np.fmin.at(best, each[fine], met[fine])
        some = pa.array(~np.isnan(best))
        return pa.Table.from_arrays([*(left.column(c).filter(some) for c in keys), pa.array(best).filter(some)], [*keys, "t"])

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    by = [*by, "_share"]
    found = thrown.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", t double")
    return found.groupBy(*keys).agg(F.min("t").alias("t"))


def blocked(segments: DataFrame, triangles: DataFrame, keys: list[str], tile: float = 8.0, d_min: float = 0.0, within: tuple[str, ...] = ()) -> DataFrame:
    """Keys of the segments that a triangle cuts, not counting the last BACK metres."""
    return nearest_hits(segments, triangles, keys, tile, lambda t, length: (length > 0) & (t * length > d_min) & (t * length < length - BACK), within).select(*keys)


def mesh_first_hit(segments: DataFrame, triangles: DataFrame, keys: list[str], tile: float = 8.0) -> DataFrame:
    """Keys with the smallest ray parameter in (0, 1) at which a triangle is met."""
    return nearest_hits(segments, triangles, keys, tile, lambda t, length: (t > 0) & (t < 1))


def hybrid(seen: DataFrame, triangles: DataFrame, keys: list[str]) -> DataFrame:
    """A heightfield's verdict (visible) and no triangle in between; only what is visible is tested."""
    cut = blocked(seen.where("visible").select(*keys, "ex", "ey", "ez", "tx", "ty", "tz"), triangles, keys)
    return seen.join(cut.withColumn("cut", F.lit(True)), keys, "left").withColumn("visible", F.col("visible") & F.col("cut").isNull()).drop("cut")


def hybrid_first_hit(ground: DataFrame, triangles: DataFrame, keys: list[str], max_range: float) -> DataFrame:
    """ground (keys, ex, ey, ez, ux, uy, slope, hit: metres to the heightfield, null for a miss) with hit the nearer of that and of the first triangle."""
    far = ground.select(*keys, "ex", "ey", "ez", (F.col("ex") + F.col("ux") * max_range).alias("tx"), (F.col("ey") + F.col("uy") * max_range).alias("ty"), (F.col("ez") + F.col("slope") * max_range).alias("tz"))
    met = mesh_first_hit(far, triangles, keys).select(*keys, (F.col("t") * max_range).alias("_m"))
    return ground.join(met, keys, "left").withColumn("hit", F.least("hit", "_m")).drop("_m")


def box_triangles(rects: DataFrame, base: Column, top: Column) -> DataFrame:
    """The four walls and the roof of each rectangle (id, x0, y0, x1, y1) as outward triangles."""
    lo, hi = base, top
    x0, y0, x1, y1 = (F.col(k) for k in ("x0", "y0", "x1", "y1"))
    quads = [((x0, y0, lo), (x1, y0, lo), (x1, y0, hi), (x0, y0, hi)), ((x1, y0, lo), (x1, y1, lo), (x1, y1, hi), (x1, y0, hi)), ((x1, y1, lo), (x0, y1, lo), (x0, y1, hi), (x1, y1, hi)), ((x0, y1, lo), (x0, y0, lo), (x0, y0, hi), (x0, y1, hi)), ((x0, y0, hi), (x1, y0, hi), (x1, y1, hi), (x0, y1, hi))]
    corner = lambda n, p: [c.cast("double").alias(n + k) for k, c in zip("xyz", p)]
    tris = [F.struct(F.lit(2 * i + j).alias("tri"), *corner("a", q[0]), *corner("b", q[1 + j]), *corner("c", q[2 + j])) for i, q in enumerate(quads) for j in (0, 1)]
    return rects.select(F.col("id").alias("bid"), F.explode(F.array(*tris)).alias("t")).select("bid", "t.*")


def measures(triangles: DataFrame) -> DataFrame:
    """Per building: triangles that aren't degenerate, area, and signed volume about the building's own centre.

    The volume under a triangle about m is (a - m) n / 6, n its normal, so sums of a n and
    of n give it for the centre too, and one grouping does.
    """
    a, b, c = (_corner(p) for p in "abc")
    n = _cross(_minus(b, a), _minus(c, a))
    normal = dict(zip(("_nx", "_ny", "_nz"), n))
    rows = triangles.withColumns({f"_m{k}": (F.col("a" + k) + F.col("b" + k) + F.col("c" + k)) / 3 for k in "xyz"} | normal)
    n = tuple(map(F.col, normal))
    rows = rows.withColumns({"_area": F.sqrt(_dot(n, n)) / 2, "_an": _dot(a, n)})
    fine = F.col("_area") * 2 >= 2e-9
    sums = rows.groupBy("bid").agg(F.count_if(fine).alias("n"), F.sum(F.when(fine, F.col("_area"))).alias("area"), F.sum(F.when(fine, F.col("_an"))).alias("_an"), *(F.sum(F.when(fine, F.col(k))).alias(k) for k in normal), *(F.avg(f"_m{k}").alias(f"_m{k}") for k in "xyz"))
    return sums.where("n > 0").select("bid", "n", "area", ((F.col("_an") - _dot(tuple(F.col(f"_m{k}") for k in "xyz"), n)) / 6).alias("volume"))


def open_edges(triangles: DataFrame) -> DataFrame:
    """Per building: edges, undirected, of one triangle only."""
    point = lambda p: F.struct(*(F.round(F.col(p + k) * 1e6).cast("long").alias(k) for k in "xyz"))
    pairs = F.array(*(F.struct(F.least(point(p), point(q)).alias("p"), F.greatest(point(p), point(q)).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    counted = triangles.select("bid", F.explode(pairs).alias("edge")).groupBy("bid", "edge").count()
    return counted.groupBy("bid").agg(F.count("*").alias("edges"), F.count_if(F.col("count") == 1).alias("open"), F.count_if(F.col("count") % 2 == 1).alias("odd"))


def voxel_faces(voxels: DataFrame) -> DataFrame:
    """Faces (r, c, l, axis, side) of the voxels (r, c, l) that have no neighbour there."""
    sides = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side")) for a in "rcl" for s in (-1, 1)))
    faces = voxels.select("r", "c", "l").withColumn("f", F.explode(sides)).select("r", "c", "l", "f.axis", "f.side")
    beside = faces.withColumns({"nr": F.col("r") + F.when(F.col("axis") == "r", F.col("side")).otherwise(0), "nc": F.col("c") + F.when(F.col("axis") == "c", F.col("side")).otherwise(0), "nl": F.col("l") + F.when(F.col("axis") == "l", F.col("side")).otherwise(0)})
    filled = voxels.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("l").alias("nl"))
    return beside.join(filled, ["nr", "nc", "nl"], "left_anti").drop("nr", "nc", "nl")


#: Corners of a voxel's faces, counter-clockwise from outside, as steps from (r, c, l) on; rows run against y.
FACE_CORNERS = {("c", 1): ((1, 1, 0), (0, 1, 0), (0, 1, 1), (1, 1, 1)), ("c", -1): ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)), ("r", -1): ((0, 1, 0), (0, 0, 0), (0, 0, 1), (0, 1, 1)), ("r", 1): ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)), ("l", 1): ((1, 0, 1), (1, 1, 1), (0, 1, 1), (0, 0, 1)), ("l", -1): ((1, 0, 0), (0, 0, 0), (0, 1, 0), (1, 1, 0))}


def indexed_mesh(voxels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closed surface of voxels (r, c, l): vertices (v, r, c, l), numbered from 0 without gaps in order of their place, and triangles (a, b, d) by vertex number, turned outwards.

    Numbers come from a sort by ranges and the ranges' sizes, so no task sees all vertices.
    """
    faces = kept(voxel_faces(voxels).withColumn("face", F.xxhash64("r", "c", "l", "axis", "side")))
    steps = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"), F.array(*(F.struct(*(F.lit(d).alias(k) for d, k in zip(p, "rcl"))) for p in ps)).alias("at")) for (a, s), ps in FACE_CORNERS.items()))
    own = F.filter(steps, lambda x: (x["axis"] == F.col("axis")) & (x["side"] == F.col("side")))
    corners = faces.withColumn("_at", F.get(own, 0)["at"]).select(F.struct("r", "c", "l", "axis", "side").alias("face"), "r", "c", "l", F.posexplode("_at").alias("k", "d")).select("face", "k", *((F.col(x) + F.col(f"d.{x}")).cast("int").alias(x) for x in "rcl"))
    corners = kept(corners)
    every = numbered(corners.select("r", "c", "l").distinct().withColumn("_all", F.lit(0)), ["_all"], ["r", "c", "l"], "v").drop("_all")
    vertices = kept(every.withColumn("v", (F.col("v") - 1).cast("long")))
    quads = corners.join(vertices, ["r", "c", "l"]).groupBy("face").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)))
    both = F.array(*(F.struct(*(F.col(f"v{x}").alias(n) for x, n in zip(t, "abd"))) for t in ((0, 1, 2), (0, 2, 3))))
    return vertices, quads.select(F.explode(both).alias("t")).select("t.*")


def mesh_numbers(vertices: DataFrame, faces: DataFrame, at: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """One row about an indexed mesh: vertices, edges, faces, euler (vertices - edges + faces), odd (edges of an odd number of triangles), unpaired (edges not run through once each way for each pair of triangles) and signed volume."""
    ends = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("way")) for p, q in (("a", "b"), ("b", "d"), ("d", "a"))))
    edges = faces.select(F.explode(ends).alias("e")).groupBy("e.p", "e.q").agg(F.count("*").alias("n"), F.sum("e.way").alias("way"))
    sums = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("n") % 2 == 1).alias("odd"), F.count_if(F.col("way") != 0).alias("unpaired"))
    low = vertices.agg(*(F.avg(c).alias(f"_m{k}") for k, c in enumerate(at)))
    place = vertices.join(F.broadcast(low)).select("v", *((F.col(c) - F.col(f"_m{k}")).alias(f"_{k}") for k, c in enumerate(at)))
    t = faces
    for n in "abd":
        t = t.join(place.select(F.col("v").alias(n), *(F.col(f"_{k}").alias(f"{n}{k}") for k in range(3))), n)
    volume = _dot(tuple(F.col(f"a{k}") for k in range(3)), _cross(tuple(F.col(f"b{k}") for k in range(3)), tuple(F.col(f"d{k}") for k in range(3)))) / 6
    sized = t.agg(F.count("*").alias("faces"), F.coalesce(F.sum(volume), F.lit(0.0)).alias("volume"))
    return vertices.agg(F.count("*").alias("vertices")).join(sums).join(sized).withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def crosses_opening(s0: str = "s0", s1: str = "s1", z0: str = "z0", z1: str = "z1") -> Column:
    """Whether a segment passes a wall's opening: rows hold the wall point (wx, wy), its tangent (ux, uy), thickness, and the opening's span and heights. The plane is tested at the wall's outer face and, if it is thick, at the inner one."""

    def at(offset: Column) -> Column:
        nx, ny = -F.col("uy"), F.col("ux")
        side = lambda p: (F.col(p + "x") - F.col("wx")) * nx + (F.col(p + "y") - F.col("wy")) * ny - offset
        t = F.try_divide(side("e"), side("e") - side("t"))
        x, y, z = (F.col("e" + k) + t * (F.col("t" + k) - F.col("e" + k)) for k in "xyz")
        along = (x - F.col("wx")) * F.col("ux") + (y - F.col("wy")) * F.col("uy")
        return F.coalesce((t > 0) & (t < 1) & along.between(F.col(s0), F.col(s1)) & z.between(F.col(z0), F.col(z1)), F.lit(False))

    return at(F.lit(0.0)) & F.when(F.col("thickness") > 0, at(F.col("thickness"))).otherwise(True)
