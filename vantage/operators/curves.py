"""Curves of drawings: arcs, circles and bulged lines as chords to a tolerance.

Every entity becomes pieces, each from one point to another with a bulge (the tangent of a
quarter of the angle that it turns, positive to the left, 0 for straight). A circle is two
pieces, an arc too, so no piece turns by more than half a circle unless its bulge says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .solids import affine_apply

#: The format's group codes.
LAYER, X, Y, X2, Y2, RADIUS, BULGE, FROM, TO, FLAGS = 8, 10, 20, 11, 21, 40, 42, 50, 51, 70
ENDS = ("ax", "ay", "bx", "by")


def pieces(entities: DataFrame, key: list[str]) -> DataFrame:
    """key, kind, layer, piece, ax, ay, bx, by, bulge of entities (key, kind, tags: code and value in order).

    Lines, arcs, circles and polylines count; others give nothing. A polyline's last vertex
    meets its first where flag 1 is set. Vertices and entities that lack a number give no
    piece; an arc whose ends are one angle is a circle; without a layer it is '0'.
    """
    safe = entities.withColumn("layer", F.expr(f"coalesce(try_element_at(filter(tags, t -> t.code = {LAYER}), 1).value, '0')"))
    one = lambda code: F.expr(f"try_cast(try_element_at(filter(tags, t -> t.code = {code}), 1).value AS double)")
    base = [*key, "kind", "layer"]

    lines = safe.where("kind = 'LINE'").select(*base, F.lit(0).alias("piece"), one(X).alias("ax"), one(Y).alias("ay"), one(X2).alias("bx"), one(Y2).alias("by"), F.lit(0.0).alias("bulge"))

    turn = F.pmod(one(TO) - one(FROM), F.lit(360.0))
    round_ = safe.where("kind IN ('ARC', 'CIRCLE')").withColumns({"_x": one(X), "_y": one(Y), "_r": one(RADIUS), "_f": F.when(F.col("kind") == "CIRCLE", 0.0).otherwise(one(FROM)), "_s": F.when(F.col("kind") == "CIRCLE", 360.0).when(turn == 0, 360.0).otherwise(turn)})
    halves = round_.where("_r > 0").withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1))))
    on = lambda f, centre, n: F.col(centre) + F.col("_r") * f(F.radians(F.col("_f") + F.col("_s") / 2 * n))
    i = F.col("piece")
    arcs = halves.select(*base, "piece", on(F.cos, "_x", i).alias("ax"), on(F.sin, "_y", i).alias("ay"), on(F.cos, "_x", i + 1).alias("bx"), on(F.sin, "_y", i + 1).alias("by"), F.tan(F.radians(F.col("_s")) / 8).alias("bulge"))

    poly = safe.where("kind = 'LWPOLYLINE'").withColumn("_closed", F.coalesce(one(FLAGS), F.lit(0.0)).cast("int").bitwiseAND(1) == 1)
    tags = poly.select(*base, "_closed", F.posexplode("tags").alias("_i", "_t"))
    # numbers follow the x of their vertex
    each = tags.withColumn("_v", F.count_if(F.col("_t.code") == X).over(W.partitionBy(*key).orderBy("_i")))
    of = lambda code: F.max(F.when(F.col("_t.code") == code, F.expr("try_cast(_t.value AS double)")))
    vertices = each.where("_v > 0").groupBy(*base, "_closed", "_v").agg(of(X).alias("ax"), of(Y).alias("ay"), F.coalesce(of(BULGE), F.lit(0.0)).alias("bulge")).where("ax IS NOT NULL AND ay IS NOT NULL")
    w = W.partitionBy(*key).orderBy("_v")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.when(F.col("_closed") & (F.count("*").over(whole) > 1), F.first(c).over(whole)))
    rings = vertices.withColumns({"bx": after("ax"), "by": after("ay")}).select(*base, (F.col("_v") - 1).cast("int").alias("piece"), *ENDS, "bulge")

    return lines.unionByName(arcs).unionByName(rings).where(" AND ".join(f"{c} IS NOT NULL" for c in ENDS))


def chords(curves: DataFrame, tol: float, most: int = 4096) -> DataFrame:
    """curves (any columns, ax, ay, bx, by, bulge) with seg and the ends of their chords in place of their own; none leaves its arc by more than tol.

    A piece that would need more than so many chords is an error rather than a coarser
    line. Bulged pieces without length give nothing, as they have no circle.
    """
    b = F.when(F.col("bulge") != 0, F.col("bulge"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    r = F.sqrt(dx * dx + dy * dy) * (1 + b * b) / (4 * F.abs(b))
    sweep = 4 * F.atan(b)
    n = F.ceil(F.abs(sweep) / (2 * F.acos(F.greatest(F.lit(0.0), 1 - tol / F.col("_r")))))  # null for a straight piece, as all that is worked out from b
    told = curves.where("bulge = 0 OR ax <> bx OR ay <> by").withColumn("_r", r).withColumn("_n", F.coalesce(F.when(n.isNotNull(), F.greatest(F.lit(1), n)), F.lit(1)).cast("int"))
    told = told.withColumn("_n", F.when(F.col("_n") > most, F.raise_error(F.lit("a curve needs too many chords"))).otherwise(F.col("_n")))
    # the centre lies off the middle of the chord, to the left of a piece that turns left by less than half a circle
    side = (1 - b * b) / (4 * b)
    told = told.withColumns({"_cx": (F.col("ax") + F.col("bx")) / 2 - dy * side, "_cy": (F.col("ay") + F.col("by")) / 2 + dx * side, "_s": sweep, "seg": F.explode(F.sequence(F.lit(0), F.col("_n") - 1))})

    def at(k: Column, own: str, centre: str, this: Column, other: Column) -> Column:
        a = F.col("_s") * k / F.col("_n")
        return F.when(k == 0, F.col("a" + own)).when(k == F.col("_n"), F.col("b" + own)).otherwise(F.col(centre) + this * F.cos(a) + other * F.sin(a))

    ux, uy = F.col("ax") - F.col("_cx"), F.col("ay") - F.col("_cy")
    k = F.col("seg")
    ends = {"_ax": at(k, "x", "_cx", ux, -uy), "_ay": at(k, "y", "_cy", uy, ux), "_bx": at(k + 1, "x", "_cx", ux, -uy), "_by": at(k + 1, "y", "_cy", uy, ux)}
    rest = [c for c in curves.columns if c not in (*ENDS, "bulge")]
    return told.withColumns(ends).select(*rest, "seg", *(F.col("_" + c).alias(c) for c in ENDS))


def moved(segments: DataFrame, m: list[Column]) -> DataFrame:
    """segments with both ends put through an affine map of six columns, which may differ by row."""
    (ax, ay), (bx, by) = (affine_apply(m, F.col(p + "x"), F.col(p + "y")) for p in "ab")
    return segments.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})
