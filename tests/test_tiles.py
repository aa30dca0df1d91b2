"""Rays over tiles: the same as the two other ways, and no more rows than rays cross tiles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vantage.operators import grid as g
from vantage.operators import surface as s
from vantage.operators import tiles as t
from vantage.operators import visibility as v
from vantage.session import table

SIDE = 2000
GRID = g.Grid(h=SIDE, w=SIDE)


@pytest.fixture(scope="module")
def wide(spark, sf_dir):
    """2,000 x 2,000 cells: a profile of the orders along rows and one of the lines along columns, with holes."""
    a = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % SIDE).cast("int").alias("r")).agg((F.sum("o_custkey") % 23).alias("a"))
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") * 37 % SIDE).cast("int").alias("c")).agg((F.sum("l_suppkey") % 19).alias("b"))
    rows = spark.range(SIDE).select(F.col("id").cast("int").alias("r")).join(a, "r", "left").fillna(5)
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).join(b, "c", "left").fillna(3)
    z = (F.col("a") * F.col("b") + F.col("r") * 3 + F.col("c")) % 29
    dem = cells.select("r", "c", F.when((F.col("r") * 31 + F.col("c") * 17) % 97 > 0, z.cast("double")).alias("z"))
    four = g.corners(dem)
    four.write.mode("overwrite").parquet(path := f"{spark.sparkContext._jvm.java.lang.System.getProperty('java.io.tmpdir')}/vantage-wide-surface")
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def array(wide):
    return s.small_surface(wide, SIDE * SIDE)


@pytest.fixture(scope="module")
def rays(spark, sf_dir):
    k = F.col("c_custkey")
    at = lambda a, b: (k * a % 1900 + b).cast("double")
    ends = table(spark, sf_dir, "customer").select(k.alias("k"), at(911, 40.5).alias("ex"), (-at(577, 40.5)).alias("ey"), (k % 60 + 20).cast("double").alias("ez"), at(389, 60.25).alias("tx"), (-at(773, 20.75)).alias("ty"), (k * 7 % 60 + 10).cast("double").alias("tz"))
    odd = spark.createDataFrame([(-1, 50.5, -50.5, 30.0, 50.5, -50.5, 1.0), (-2, 50.5, -50.5, 30.0, 51.0, -50.5, 1.0), (-3, 50.5, -50.5, 30.0, 900.5, -50.5, None), (-4, -50.0, 70.0, 60.0, 2500.0, -1500.0, 45.0), (-5, 5000.0, 70.0, 60.0, 5050.0, 90.0, 45.0)], "k long, ex double, ey double, ez double, tx double, ty double, tz double")
    return ends.unionByName(odd)


def rows(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_three_ways_see_the_same(wide, array, rays):
    by_tiles = rows(t.line_of_sight(rays, t.tiled(wide), GRID, ["k"]), "k", "dist", "visible")
    in_tasks = rows(v._marched(rays, array, GRID, 1.0, 1.0), "k", "dist", "visible")
    joined = rows(v._joined(rays, wide, GRID, ["k"], 1.0, 1.0), "k", "dist", "visible")
    assert by_tiles == in_tasks == joined
    seen = [x[2] for x in by_tiles]
    assert 20 < sum(seen) < len(seen) - 20


def test_three_ways_hit_the_same(wide, array, rays):
    d = F.sqrt((F.col("tx") - F.col("ex")) ** 2 + (F.col("ty") - F.col("ey")) ** 2)
    ahead = rays.where("k > 0").select("k", "ex", "ey", (F.col("ez") + 30).alias("ez"), ((F.col("tx") - F.col("ex")) / d).alias("ux"), ((F.col("ty") - F.col("ey")) / d).alias("uy"), (-(F.col("k") % 7) / 60.0).alias("slope"), F.lit(-1.0).alias("f0"))
    in_tasks = rows(v.first_hit(ahead, wide, GRID, ["k"], 700.0, surface=array), "k", "hit")
    joined = rows(v._joined_hits(ahead, wide, GRID, ["k"], 700.0), "k", "hit")
    met = t.first_hit(ahead, t.tiled(wide), GRID, ["k"], 1.0, 700)
    by_tiles = rows(v._hit_between(met, F.col("_k"), F.col("_f"), F.coalesce("_before", "f0"), 1.0), "k", "hit")
    assert by_tiles == in_tasks == joined
    found = [h for _, h in by_tiles if h is not None]
    assert 20 < len(found) and max(found) - min(found) > 300


def test_pieces_are_the_tiles_that_rays_cross(rays):
    """Rows that are shuffled: one a ray and tile, far fewer than samples; a wave takes no more tiles than asked for."""
    d = F.sqrt((F.col("tx") - F.col("ex")) ** 2 + (F.col("ty") - F.col("ey")) ** 2)
    going = rays.where("k > 0").select("k", "ex", "ey", "ez", ((F.col("tx") - F.col("ex")) / d).alias("ux"), ((F.col("ty") - F.col("ey")) / d).alias("uy"), F.lit(0.0).alias("slope"), F.lit(1).cast("long").alias("next"), F.floor(d - 1).cast("long").alias("last")).where("last >= 1")
    found = t.pieces(going, GRID, ["k"], 1.0, t.TILE, 1 << 20).collect()
    crossed, samples = 0, 0
    for r in going.collect():
        places = []
        for k in range(1, r["last"] + 1):
            rf, cf = -(r["ey"] + r["uy"] * k) - 0.5, r["ex"] + r["ux"] * k - 0.5
            places.append((rf // 1 // t.TILE, cf // 1 // t.TILE))
        crossed += sum(a != b for a, b in zip(places, [None, *places]))
        samples += len(places)
    assert len(found) == crossed < samples / 30
    assert sum(r["final"] - r["first"] + 1 for r in found) == samples
    assert max(r["n"] for r in t.pieces(going, GRID, ["k"], 1.0, t.TILE, 2).groupBy("k").agg(F.count("*").alias("n")).collect()) == 2


def test_hot_tiles_are_dealt_to_several_tasks(wide, rays, monkeypatch):
    whole = rows(t.line_of_sight(rays, t.tiled(wide), GRID, ["k"]), "k", "visible")
    monkeypatch.setattr(t, "PER_TASK", 500)
    assert rows(t.line_of_sight(rays, t.tiled(wide), GRID, ["k"]), "k", "visible") == whole


def test_no_rays_and_no_surface(wide, rays):
    assert t.line_of_sight(rays.limit(0), t.tiled(wide), GRID, ["k"]).count() == 0
    seen = rows(t.line_of_sight(rays, t.tiled(wide.limit(0)), GRID, ["k"]), "k", "visible")
    assert [x for x in seen if not x[1]] == [(-3, False), (-1, False)]
