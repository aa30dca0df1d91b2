"""Plans matched to walls, planes and affine maps fitted, shells with openings built, points put inside rings.

Walls are rows (key, wall, x0, y0, x1, y1), plan lines rows (key, seg, ax, ay, bx, by).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import shuffled
from .sequence import merge_intervals


def _f(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def plane_fit(points: DataFrame, key: list[str]) -> DataFrame:
    """key, a, b, c, n of the least-squares plane z = a x + b y + c over points (x, y, z) with a finite height; level at their mean where fewer than three, or all on one line, hold it."""
    # sums from a corner of each key's points, times n: of whole numbers they are exact, and one division rounds
    ok = points.where("z IS NOT NULL AND NOT isnan(z)")
    ok = ok.withColumns({f"_o{v}": F.floor(F.min(v).over(W.partitionBy(*key))).cast("double") for v in "xy"})
    ok = ok.withColumns({"x": F.col("x") - F.col("_ox"), "y": F.col("y") - F.col("_oy")})
    m = ok.groupBy(*key).agg(F.count("*").alias("n"), *(F.first(f"_o{v}").alias(f"_o{v}") for v in "xy"), *(F.sum(v).alias(f"s{v}") for v in "xyz"), *(F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p, q in ("xx", "yy", "xy", "xz", "yz")))
    m = m.withColumns({f"c{p}{q}": F.col("n") * F.col(f"s{p}{q}") - F.col(f"s{p}") * F.col(f"s{q}") for p, q in ("xx", "yy", "xy", "xz", "yz")})
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    fine = (F.col("n") >= 3) & (det > 1e-9 * F.col("cxx") * F.col("cyy"))
    tops = {"_a": F.col("cxz") * F.col("cyy") - F.col("cyz") * F.col("cxy"), "_b": F.col("cyz") * F.col("cxx") - F.col("cxz") * F.col("cxy"), "_d": det}
    m = m.withColumns({k: F.when(fine, v).otherwise(1.0 if k == "_d" else 0.0) for k, v in tops.items()})
    at = lambda v: F.col(f"s{v}") + F.col("n") * F.col(f"_o{v}")
    c = (F.col("sz") * F.col("_d") - F.col("_a") * at("x") - F.col("_b") * at("y")) / (F.col("n") * F.col("_d"))
    return m.select(*key, (F.col("_a") / F.col("_d")).alias("a"), (F.col("_b") / F.col("_d")).alias("b"), c.alias("c"), "n")


def affine_fit(pairs: DataFrame, rounds: int = 10, floor: float = 5.0) -> tuple[list[float], int]:
    """[a, b, c, d, e, f] with u = a x + c y + e and v = b x + d y + f, and the rows kept, by least squares over pairs (x, y, u, v).

    Refitted without the rows farther off than median + 3 robust deviations, or floor if
    that is more, until their number stays. Only sums and medians reach the driver.
    """
    kept, count, m = pairs, None, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    moments = [F.count("*").alias("n"), *(F.avg(v).alias("m" + v) for v in "xyuv"), *(F.covar_pop(p, q).alias("c" + p + q) for p, q in ("xx", "yy", "xy", "xu", "yu", "xv", "yv"))]
    for _ in range(rounds):
        s = kept.agg(*moments).first()
        if s["n"] < 3 or s["n"] == count:
            break
        count = s["n"]
        det = s["cxx"] * s["cyy"] - s["cxy"] ** 2
        if abs(det) < 1e-12:
            break
        a, c, b, d = ((s["cx" + t] * s["cyy"] - s["cy" + t] * s["cxy"]) / det if k == 0 else (s["cy" + t] * s["cxx"] - s["cx" + t] * s["cxy"]) / det for t in "uv" for k in (0, 1))
        m = [a, b, c, d, s["mu"] - a * s["mx"] - c * s["my"], s["mv"] - b * s["mx"] - d * s["my"]]
        u, v = affine_apply([F.lit(x) for x in m], F.col("x"), F.col("y"))
        off = F.sqrt((u - F.col("u")) * (u - F.col("u")) + (v - F.col("v")) * (v - F.col("v")))
        med = pairs.agg(F.median(off)).first()[0]
        mad = pairs.agg(F.median(F.abs(off - med))).first()[0]
        kept = pairs.where(off <= max(med + 3 * 1.4826 * mad, floor))
    return m, count or 0


def affine_apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def affine_concat(m: list[Column], n: list[Column]) -> list[Column]:
    """m, then n."""
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]


def polyline_segments(vertices: DataFrame, key: list[str], order: str, closed: str) -> DataFrame:
    """Consecutive vertices (x, y) of each line as segments; the last meets the first where closed."""
    w = W.partitionBy(*key).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = vertices.withColumns({"bx": F.coalesce(F.lead("x").over(w), F.when(F.col(closed), F.first("x").over(whole))), "by": F.coalesce(F.lead("y").over(w), F.when(F.col(closed), F.first("y").over(whole)))})
    return v.where("bx IS NOT NULL").select(*key, F.col(order).alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


def in_wall_frame(walls: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """Walls with each line of their key, its ends along the wall (sa, sb) and off it, outwards (na, nb)."""
    x0, y0, x1, y1 = _f("x0", "y0", "x1", "y1")
    w = walls.withColumn("len", F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).where("len > 0")
    w = w.withColumns({"ux": (x1 - x0) / F.col("len"), "uy": (y1 - y0) / F.col("len")})
    along = lambda p: (F.col(p + "x") - x0) * F.col("ux") + (F.col(p + "y") - y0) * F.col("uy")
    off = lambda p: (F.col(p + "x") - x0) * F.col("uy") - (F.col(p + "y") - y0) * F.col("ux")
    return w.join(shuffled(segments), key).withColumns({"sa": along("a"), "sb": along("b"), "na": off("a"), "nb": off("b")})


def best_shift(walls: DataFrame, segments: DataFrame, key: list[str], radius: float = 3.0, step: float = 0.25, corridor: float = 0.6) -> DataFrame:
    """key, dx, dy: the shift of the lines that covers most wall, the first of equals; none where standing still covers 95 % of that."""
    k = int(round(radius / step))
    each = in_wall_frame(walls, segments, key).select(*key, "len", "ux", "uy", "sa", "sb", "na", "nb")
    shifts = F.sequence(F.lit(-k), F.lit(k))
    moved = each.withColumn("i", F.explode(shifts)).withColumn("j", F.explode(shifts)).withColumns({"dx": F.col("i") * step, "dy": F.col("j") * step})
    ds, dn = F.col("ux") * F.col("dx") + F.col("uy") * F.col("dy"), F.col("uy") * F.col("dx") - F.col("ux") * F.col("dy")
    inside = F.greatest(F.abs(F.col("na") + dn), F.abs(F.col("nb") + dn)) <= corridor
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.col("len"))
    cover = F.when(inside, clip(F.greatest("sa", "sb") + ds) - clip(F.least("sa", "sb") + ds)).otherwise(0.0)
    # sums in thousandths, so that equal covers are equal whatever the order of rows
    total = moved.groupBy(*key, "i", "j", "dx", "dy").agg(F.sum(F.rint(cover * 1000)).alias("cover"))
    best = total.groupBy(*key).agg(F.max_by(F.struct("dx", "dy"), F.struct("cover", -F.col("i"), -F.col("j"))).alias("to"), F.max("cover").alias("most"), F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("cover"))).alias("still"))
    stays = F.col("still") >= 0.95 * F.col("most")
    return best.select(*key, F.when(stays, 0.0).otherwise(F.col("to.dx")).alias("dx"), F.when(stays, 0.0).otherwise(F.col("to.dy")).alias("dy"))


def stubs(walls: DataFrame, segments: DataFrame, key: list[str], max_perp: float = 0.35, lengths: tuple = (0.15, 4.0), near: float = 0.6, depths: tuple = (0.3, 3.0)) -> DataFrame:
    """key, wall, seg, s, depth, length of lines that run from a wall squarely into its building."""
    e = in_wall_frame(walls, segments, key)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    e = e.withColumns({"length": F.sqrt(dx * dx + dy * dy), "depth": -F.least("na", "nb"), "s": (F.col("sa") + F.col("sb")) / 2})
    lean = F.abs(dx * F.col("ux") + dy * F.col("uy"))
    fits = F.col("length").between(*lengths) & (lean <= max_perp * F.col("length")) & (F.least(F.abs("na"), F.abs("nb")) <= near) & F.col("depth").between(*depths) & F.col("s").between(F.lit(-0.1), F.col("len") + 0.1)
    return e.where(fits).select(*key, "wall", "seg", "s", "depth", "length")


def passages(found: DataFrame, key: list[str], low: float = 0.5, high: float = 1.6, like: float = 0.9) -> DataFrame:
    """The best two stubs of each wall that stand a door's width apart: the deepest, then the likest in width. key, wall, s, width, depth."""
    a = found.select(*key, "wall", F.struct("s", "depth", "seg").alias("a"))
    b = found.select(*key, "wall", F.struct("s", "depth", "seg").alias("b"))
    width, depth = F.col("b.s") - F.col("a.s"), F.least("a.depth", "b.depth")
    both = a.join(shuffled(b), [*key, "wall"]).where(width.between(low, high)).withColumns({"width": width, "depth": depth, "s": (F.col("a.s") + F.col("b.s")) / 2})
    return both.groupBy(*key, "wall").agg(F.max_by(F.struct("s", "width", "depth"), F.struct("depth", -F.abs(F.col("width") - like), -F.col("a.s"))).alias("p")).select(*key, "wall", "p.*")


def rank_openings(doors: DataFrame, gaps: DataFrame, key: list[str]) -> DataFrame:
    """Door candidates (key, place, wall, s, width, confidence): passages, surer where a gap (key, wall, s, width) stands at the same place, and the gaps that no passage took; more than three make all doubtful."""
    g = gaps.select(*key, "wall", F.col("s").alias("gs"), F.col("width").alias("gw"))
    met = doors.join(shuffled(g), [*key, "wall"]).where(F.abs(F.col("gs") - F.col("s")) < F.greatest(F.lit(0.6), F.col("width")))
    first = met.withColumn("_k", F.row_number().over(W.partitionBy(*key, "wall").orderBy("gs"))).where("_k = 1").select(*key, "wall", "gs", "gw")
    sure = doors.join(shuffled(first.select(*key, "wall", F.lit(True).alias("met"))), [*key, "wall"], "left")
    level = F.when(F.col("met"), "high").when((F.col("depth") >= 0.5) & F.col("width").between(0.6, 1.5), "med").otherwise("low")
    alone = g.join(shuffled(first), [*key, "wall", "gs", "gw"], "left_anti").select(*key, "wall", F.col("gs").alias("s"), F.col("gw").alias("width"), F.lit("low").alias("confidence"))
    all_ = sure.select(*key, "wall", "s", "width", level.alias("confidence")).unionByName(alone)
    all_ = all_.withColumn("confidence", F.when(F.count("*").over(W.partitionBy(*key)) > 3, "low").otherwise(F.col("confidence")))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "med", 1).otherwise(2)
    return all_.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(rank, F.desc("width"), "wall", "s")))


def panel_bands(panels: DataFrame, holes: DataFrame, key: list[str]) -> DataFrame:
    """What is left of a wall's face beside its holes, as upright bands: key, s0, s1 and the heights of the lower (lo0, lo1) and upper edge (hi0, hi1) at both.

    panels: key, length, and base and top at both ends (zb0, zb1, zt0, zt1); holes: key,
    s0, s1, z0, z1. The holes' ends cut the face into columns; in each the heights that
    holes take are merged, and the bands are what stays between base and top.
    """
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("length"))
    h = holes.join(shuffled(panels.select(*key, "length")), key)
    cuts = h.select(*key, F.explode(F.array(inside(F.col("s0")), inside(F.col("s1")))).alias("s")).unionByName(panels.select(*key, F.explode(F.array(F.lit(0.0), F.col("length"))).alias("s"))).distinct()
    columns = cuts.withColumn("to", F.lead("s").over(W.partitionBy(*key).orderBy("s"))).where("to - s > 1e-9")
    middle = (F.col("s") + F.col("to")) / 2
    taken = columns.join(shuffled(holes.withColumnsRenamed({"z0": "lo", "z1": "hi"})), key).where(middle.between(F.col("s0") - 1e-9, F.col("s1") + 1e-9)).select(*key, "s", "lo", "hi")
    merged = merge_intervals(taken, [*key, "s"], 1e-9).select(*key, "s", "lo", "hi")
    column = columns.join(shuffled(panels), key)
    at = lambda a, b, s: F.col(a) + (F.col(b) - F.col(a)) * F.col(s) / F.col("length")
    column = column.withColumns({"b0": at("zb0", "zb1", "s"), "b1": at("zb0", "zb1", "to"), "t0": at("zt0", "zt1", "s"), "t1": at("zt0", "zt1", "to")})
    order = W.partitionBy(*key, "s").orderBy("lo")
    rows = column.join(shuffled(merged), [*key, "s"], "left").withColumns({"before": F.lag("hi").over(order), "last": F.lead("lo").over(order).isNull()})
    under = F.struct(F.coalesce("before", "b0").alias("lo0"), F.coalesce("before", "b1").alias("lo1"), F.coalesce("lo", "t0").alias("hi0"), F.coalesce("lo", "t1").alias("hi1"))
    over = F.struct(F.col("hi").alias("lo0"), F.col("hi").alias("lo1"), F.col("t0").alias("hi0"), F.col("t1").alias("hi1"))
    bands = rows.select(*key, F.col("s").alias("s0"), F.col("to").alias("s1"), F.explode(F.when(F.col("last") & F.col("lo").isNotNull(), F.array(under, over)).otherwise(F.array(under))).alias("q")).select(*key, "s0", "s1", "q.*")
    return bands.where("hi0 - lo0 > 1e-9 OR hi1 - lo1 > 1e-9")


def quads_to_triangles(quads: DataFrame, key: list[str]) -> DataFrame:
    """Two triangles (ax..cz) of each quad (p, q, r, t: structs of x, y, z, in turn)."""
    tri = lambda *ps: F.struct(*(F.col(f"{p}.{k}").alias(n + k) for n, p in zip("abc", ps) for k in "xyz"))
    return quads.select(*key, F.posexplode(F.array(tri("p", "q", "r"), tri("p", "r", "t"))).alias("half", "t3")).select(*key, "half", "t3.*")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def reveals(openings: DataFrame, key: list[str]) -> DataFrame:
    """The returns round openings as quads: two jambs, the soffit, the sill of those above the floor, and the back of pockets.

    openings: key, ax, ay, bx, by (its ends on the outer face), nx, ny (into the wall), depth, z0, z1, floor, pocket.
    """
    ax, ay, bx, by, d = _f("ax", "ay", "bx", "by", "depth")
    ix, iy, jx, jy = ax + F.col("nx") * d, ay + F.col("ny") * d, bx + F.col("nx") * d, by + F.col("ny") * d
    lo, hi = _f("z0", "z1")
    quad = lambda name, *ps: F.struct(F.lit(name).alias("part"), *(point(*p).alias(n) for n, p in zip("pqrt", ps)))
    sides = [quad("jamb", (ax, ay, lo), (ix, iy, lo), (ix, iy, hi), (ax, ay, hi)), quad("jamb", (bx, by, lo), (jx, jy, lo), (jx, jy, hi), (bx, by, hi)), quad("soffit", (ax, ay, hi), (bx, by, hi), (jx, jy, hi), (ix, iy, hi))]
    sill, back = quad("sill", (ax, ay, lo), (bx, by, lo), (jx, jy, lo), (ix, iy, lo)), quad("back", (ix, iy, lo), (jx, jy, lo), (jx, jy, hi), (ix, iy, hi))
    none = F.array().cast("array<struct<part:string,p:struct<x:double,y:double,z:double>,q:struct<x:double,y:double,z:double>,r:struct<x:double,y:double,z:double>,t:struct<x:double,y:double,z:double>>>")
    every = F.concat(F.array(*sides), F.when(lo > F.col("floor") + 0.05, F.array(sill)).otherwise(none), F.when(F.col("pocket"), F.array(back)).otherwise(none))
    return openings.select(*key, F.posexplode(every).alias("face", "q")).select(*key, "face", "q.*")


def dome_mesh(domes: DataFrame, key: list[str], around: int, up: int) -> DataFrame:
    """Triangles of half spheres (x, y, spring, radius): rings of quads, each two triangles, and a fan at the top."""
    turn = 6.283185307179586
    g = domes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(around - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(up - 1))))

    def at(i: Column, j: Column) -> Column:
        a, b = i * (turn / around), j * (turn / 4 / up)
        r = F.col("radius")
        return point(F.col("x") + r * F.cos(b) * F.cos(a), F.col("y") + r * F.cos(b) * F.sin(a), F.col("spring") + r * F.sin(b))

    i, j = F.col("i"), F.col("j")
    g = g.select(*key, "i", "j", at(i, j).alias("p"), at(i + 1, j).alias("q"), at(i + 1, j + 1).alias("r"), at(i, j + 1).alias("t"))
    return quads_to_triangles(g, [*key, "i", "j"]).where(f"j < {up - 1} OR half = 0")


def shell(walls: DataFrame, holes: DataFrame, key: list[str], thickness: float) -> DataFrame:
    """Triangles of a building's outer faces with their holes, and of the returns round these. walls: key, wall, x0, y0, x1, y1, zb, zt; holes: key, wall, s0, s1, z0, z1, pocket depth (null: through)."""
    x0, y0, x1, y1 = _f("x0", "y0", "x1", "y1")
    w = walls.withColumn("length", F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).withColumns({"ux": (x1 - x0) / F.col("length"), "uy": (y1 - y0) / F.col("length")})
    own = [*key, "wall"]
    bands = panel_bands(w.select(*own, "length", F.col("zb").alias("zb0"), F.col("zb").alias("zb1"), F.col("zt").alias("zt0"), F.col("zt").alias("zt1")), holes.select(*own, "s0", "s1", "z0", "z1"), own)
    on = lambda s: (x0 + F.col("ux") * F.col(s), y0 + F.col("uy") * F.col(s))
    faces = bands.join(shuffled(w.select(*own, "x0", "y0", "ux", "uy")), own)
    faces = faces.select(*own, point(*on("s0"), F.col("lo0")).alias("p"), point(*on("s1"), F.col("lo1")).alias("q"), point(*on("s1"), F.col("hi1")).alias("r"), point(*on("s0"), F.col("hi0")).alias("t"))
    o = holes.join(shuffled(w.select(*own, "x0", "y0", "ux", "uy", "zb")), own)
    o = o.select(*own, on("s0")[0].alias("ax"), on("s0")[1].alias("ay"), on("s1")[0].alias("bx"), on("s1")[1].alias("by"), (-F.col("uy")).alias("nx"), F.col("ux").alias("ny"), F.coalesce("pocket", F.lit(thickness)).alias("depth"), "z0", "z1", F.col("zb").alias("floor"), F.col("pocket").isNotNull().alias("pocket"))
    return quads_to_triangles(faces.unionByName(reveals(o, own).select(*own, "p", "q", "r", "t")), own)


def clear_spots(length: Column, n: Column, width: Column, door: Column, door_width: Column, clear: float = 0.3) -> Column:
    """Spots for n openings of one width along a wall, evenly. Without a door (null) all that fit between the wall's ends; with one, a spot too near it goes to the nearer of its sides that has room, and is dropped if there is none, as is one that meets a spot taken."""
    half = width / 2 + 0.05
    low, high = door - door_width / 2 - clear - half, door + door_width / 2 + clear + half
    room = lambda s: (s >= half) & (s <= length - half)

    def beside(s: Column) -> Column:
        a, b = F.when(room(low), low), F.when(room(high), high)
        nearer = F.when(a.isNull() | (b - s < s - a), b).otherwise(a)
        return F.when(door.isNotNull() & (s > low) & (s < high), nearer).otherwise(s)

    wanted = F.transform(F.sequence(F.lit(1), n), lambda i: beside(length * i / (n + 1)))
    fine = F.filter(wanted, lambda s: s.isNotNull() & room(s))
    take = lambda got, s: F.when(F.forall(got, lambda t: F.abs(s - t) > width + 0.05), F.concat(got, F.array(s))).otherwise(got)
    apart = F.when(door.isNull(), fine).otherwise(F.aggregate(fine, F.array().cast("array<double>"), take))
    return F.when(n > 0, apart).otherwise(F.array().cast("array<double>"))


def stacked_spots(n: Column, windows: Column, spots: Column, width: Column, sill: Column, height: Column, gap: float = 0.06) -> Column:
    """Niches on one wall: under windows (s, sill) in turn while there is room for 0.15, then at free spots apart from those. (s, sill, head, stacked)"""
    kind = "array<struct<s:double,sill:double,head:double,stacked:boolean>>"
    row = lambda s, head, stacked: F.struct(s.cast("double").alias("s"), sill.cast("double").alias("sill"), F.bround(head.cast("double"), 2).alias("head"), F.lit(stacked).alias("stacked"))
    under = F.transform(F.array_sort(windows), lambda w: row(w["s"], F.least(sill + height, w["sill"] - gap), True))
    under = F.slice(F.filter(under, lambda r: r["head"] - r["sill"] >= 0.15), 1, F.greatest(n, F.lit(0)))
    take = lambda got, s: F.when((F.size(got) < n) & F.forall(got, lambda t: F.abs(s - t["s"]) >= width + 0.05), F.concat(got, F.array(row(s, sill + height, False)))).otherwise(got)
    return F.aggregate(spots, under.cast(kind), take)


def clearance(points: DataFrame, edges: DataFrame, key: list[str], ident: str) -> DataFrame:
    """points (key, ident, px, py) with the distance to the nearest edge of their ring, and whether they lie inside it. edges: key, x0, y0, x1, y1."""
    x0, y0, x1, y1, px, py = _f("x0", "y0", "x1", "y1", "px", "py")
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))))
    gx, gy = px - (x0 + t * dx), py - (y0 + t * dy)
    crosses = ((y0 > py) != (y1 > py)) & (px < x0 + (py - y0) * F.try_divide(dx, dy))
    met = points.join(shuffled(edges), key)
    return met.groupBy(*key, ident, "px", "py").agg(F.min(F.sqrt(gx * gx + gy * gy)).alias("clear"), (F.count_if(crosses) % 2 == 1).alias("inside"))


def floor_points(edges: DataFrame, key: list[str], inset: float, spacing: float) -> DataFrame:
    """key, px, py: the lattice inside each ring that keeps inset from its edge; where that leaves none, 0.05."""
    box = edges.groupBy(*key).agg(F.min("x0").alias("lx"), F.max("x0").alias("hx"), F.min("y0").alias("ly"), F.max("y0").alias("hy"))
    steps = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(hi) - F.col(lo)) / spacing) - 1).cast("int"))
    lattice = box.withColumn("i", F.explode(steps("lx", "hx"))).withColumn("j", F.explode(steps("ly", "hy"))).withColumns({"px": F.col("lx") + (F.col("i") + 0.5) * spacing, "py": F.col("ly") + (F.col("j") + 0.5) * spacing, "node": F.struct("i", "j")})
    c = clearance(lattice.select(*key, "node", "px", "py"), edges, key, "node").where("inside AND clear >= 0.05")
    wide = F.max("clear").over(W.partitionBy(*key)) >= inset
    return c.withColumn("wide", wide).where(F.when(F.col("wide"), F.col("clear") >= inset).otherwise(True)).select(*key, "px", "py", "clear")


def inner_discs(edges: DataFrame, key: str, tol: float = 0.05) -> DataFrame:
    """key, px, py, radius: the widest disc inside each ring, to within tol. A ring's edges are one group; squares that can't hold a wider disc are not looked into."""
    import numpy as np

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[["x0", "y0"]].to_numpy(), pdf[["x1", "y1"]].to_numpy()
        d = b - a

        def signed(p: np.ndarray) -> np.ndarray:
            t = np.clip(((p[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
            gap = np.sqrt(((p[:, None] - a - t[..., None] * d) ** 2).sum(2)).min(1)
            up = (a[:, 1] > p[:, None, 1]) != (b[:, 1] > p[:, None, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                cut = up & (p[:, None, 0] < a[:, 0] + (p[:, None, 1] - a[:, 1]) * d[:, 0] / d[:, 1])
            return np.where(cut.sum(1) % 2 == 1, gap, -gap)

        low, high = a.min(0), a.max(0)
        half = max(float((high - low).min()) / 2, tol)
        xs, ys = (np.arange(low[k] + half, high[k] + half, 2 * half) for k in (0, 1))
        cells = np.array([(x, y) for x in xs for y in ys] + [tuple(a.mean(0))])
        best, where = -np.inf, cells[0]
        while len(cells):
            s = signed(cells)
            if s.max() > best:
                best, where = float(s.max()), cells[int(s.argmax())]
            cells = cells[s + half * np.sqrt(2) > best + tol]
            half /= 2
            cells = np.concatenate([cells + half * np.array(q) for q in ((-1, -1), (-1, 1), (1, -1), (1, 1))]) if len(cells) else cells
        return pd.DataFrame({key: [pdf[key].iloc[0]], "px": [where[0]], "py": [where[1]], "radius": [best]})

    kinds = dict(edges.dtypes)
    return edges.select(key, "x0", "y0", "x1", "y1").groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, px double, py double, radius double")


def built_thickness(nominal: Column, vertices: Column, radius: Column, rule: float) -> Column:
    """The thickness that a ring is built at: none for round ones of more than 30 vertices, and for those too small for three times the rule."""
    return F.when((vertices > 30) | (radius < 3 * rule), 0.0).otherwise(nominal)


def door_frames(doors: DataFrame) -> DataFrame:
    """doors (x0, y0, x1, y1, s, width, ix, iy: a point inside) with the door's middle, tangent, and the normal that points away from inside, and the point half a metre in."""
    x0, y0, x1, y1 = _f("x0", "y0", "x1", "y1")
    d = doors.withColumn("len", F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))).withColumns({"ux": (x1 - x0) / F.col("len"), "uy": (y1 - y0) / F.col("len")})
    d = d.withColumns({"cx": x0 + F.col("ux") * F.col("s"), "cy": y0 + F.col("uy") * F.col("s")})
    inward = (F.col("ix") - F.col("cx")) * -F.col("uy") + (F.col("iy") - F.col("cy")) * F.col("ux") > 0
    d = d.withColumns({"nx": F.when(inward, F.col("uy")).otherwise(-F.col("uy")), "ny": F.when(inward, -F.col("ux")).otherwise(F.col("ux"))})
    return d.withColumns({"tx": F.col("cx") - 0.5 * F.col("nx"), "ty": F.col("cy") - 0.5 * F.col("ny")}).drop("len")


def target_height(ground: Column, sill: Column, head: Column) -> Column:
    """The middle of an opening over its ground, to the millimetre; null where the ground is unknown."""
    return F.when(ground.isNotNull() & ~F.isnan(ground), F.bround(ground + (sill + head) / 2, 3))


def mesh_checks(measured: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """bid, label, ok: a mesh isn't empty, holds the expected volume to a thousandth, and has no odd edge. measured: bid, n, volume; edges: bid, odd; expected: bid, volume."""
    m = expected.select("bid", F.col("volume").alias("asked")).join(shuffled(measured.select("bid", "n", "volume")), "bid", "left").join(shuffled(edges.select("bid", "odd")), "bid", "left")
    rows = F.array(
        F.struct(F.lit("not empty").alias("label"), (F.coalesce("n", F.lit(0)) > 0).alias("ok")),
        F.struct(F.lit("volume").alias("label"), F.coalesce(F.abs(F.abs("volume") - F.col("asked")) <= 1e-3 * F.abs("asked"), F.lit(False)).alias("ok")),
        F.struct(F.lit("even edges").alias("label"), (F.coalesce("odd", F.lit(0)) == 0).alias("ok")),
    )
    return m.select("bid", F.explode(rows).alias("c")).select("bid", "c.*")
