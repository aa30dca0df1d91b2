"""Joins whose sides grow with the tables, though their files are small."""

from __future__ import annotations

import pytest

from vantage.operators import mesh as ms
from vantage.plans import catalog


@pytest.mark.parametrize(("name", "sent"), [("triangle_blocked", 2), ("triangle_first_hit", 2), ("ring_triangles", 0), ("wall_rings", 0), ("wall_thickness", 0), ("within_polygon", 0), ("nearest_wall", 0), ("plan_shift", 0), ("shell_measures", 0), ("closed_boxes", 0), ("ranked_doors", 0), ("dome_meshes", 0), ("mesh_measures", 0)])
def test_no_side_that_grows_is_sent_whole(spark, sf_dir, name, sent):
    """The plan, by sizes of files, sends no more tables to all executors than those that are counted first."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == sent


def test_a_tile_of_many_segments_is_dealt_out(spark, monkeypatch):
    """A hundred level segments at a box of one tile and of four: hits don't depend on how many tasks or pairs at once there are."""
    box = spark.sql("SELECT 1 AS id, 2.0D AS x0, 1.0D AS y0, 3.0D AS x1, 9.0D AS y1")
    seg = spark.range(100).selectExpr("id AS k", "0.0D AS ex", "id * 0.1D + 0.03 AS ey", "0.5D AS ez", "10.0D AS tx", "id * 0.1D + 0.03 AS ty", "0.5D AS tz")
    tris = ms.box_triangles(box, ms.F.lit(0.0), ms.F.lit(1.0))
    want = {k: 0.2 for k in range(100) if 1.0 <= k * 0.1 + 0.03 <= 9.0}
    for tile, per_task, pairs in ((16.0, 1 << 16, 1 << 18), (16.0, 7, 5), (5.0, 7, 5)):
        monkeypatch.setattr(ms, "PER_TASK", per_task)
        monkeypatch.setattr(ms, "PAIRS", pairs)
        assert {r["k"]: round(r["t"], 9) for r in ms.mesh_first_hit(seg, tris, ["k"], tile).collect()} == want
        assert {r["k"] for r in ms.blocked(seg, tris, ["k"], tile).collect()} == set(want)


def test_pictures_march_no_rays(spark, sf_dir):
    """Where observers fall in a picture needs their places only."""
    assert "MapInArrow" not in catalog.QUERIES["marks_in_frame"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()


def test_eyes_at_one_place_are_tried_once(spark, sf_dir, monkeypatch):
    """Checks of the engine try places, and count eyes: three eyes at two places, of which one pair stands together."""
    from vantage.operators import checks as ck
    from vantage.operators import grid as g

    tried = []
    monkeypatch.setattr(ck, "eye_cells", lambda eyes, *more: tried.append(eyes.count()) or eye_cells(eyes, *more))
    eye_cells = __import__("vantage.operators.visibility", fromlist=["eye_cells"]).eye_cells
    dem = spark.range(64).selectExpr("CAST(id % 8 AS INT) AS r", "CAST(id DIV 8 AS INT) AS c", "1.0D AS z")
    eyes = spark.sql("SELECT * FROM VALUES (1, 2.5D, -2.5D, 2.6D), (2, 2.5D, -2.5D, 2.6D), (3, 5.5D, -2.5D, 2.6D) AS t(eye, ex, ey, ez)")
    got = {r["label"]: (r["n"], r["of"]) for r in ck.engine_checks(eyes, dem, g.corners(dem), g.Grid(h=8, w=8), 1.0, 12.0, 1.6).collect()}
    assert tried == [2]
    assert got["pairs seen from one end only"] == (0, 3)
    assert got["cells lost by a higher eye"] == (0, 15)


def test_wide_rays_need_no_table_of_corners(spark, sf_dir, monkeypatch):
    """Cells go straight to tiles, the same as by way of the table of their four corners."""
    from vantage.operators import grid as g
    from vantage.operators import tiles
    from vantage.operators import visibility as v
    from vantage.plans import scenes

    grid = scenes.wide_grid(spark, sf_dir)
    dem = scenes.wide_dem(spark, sf_dir, grid)
    rays = scenes.wide_rays(spark, sf_dir, grid)
    seen = lambda surface: {(r["ray"], r["visible"]) for r in tiles.line_of_sight(rays, surface, grid, ["ray"]).collect()}
    assert seen(tiles.tiled_cells(dem, grid, 16)) == seen(tiles.tiled(g.corners(dem), 16))

    def none(*_):
        raise AssertionError("corners made")

    monkeypatch.setattr(g, "corners", none)
    monkeypatch.setattr(v, "small_surface", none)
    assert catalog.QUERIES["wide_hits"](spark, sf_dir).count() > 0
    assert catalog.QUERIES["wide_sights"](spark, sf_dir).count() > 0


def test_things_at_one_spot_see_as_one(spark):
    """Three things, two of them at one point: each of six pairs counts, none with itself, from rays of two spots."""
    from vantage.operators import nulls as nl

    places = spark.sql("SELECT * FROM VALUES (1L, 1.0D, -1.0D, 0.0D), (2L, 1.0D, -1.0D, 0.0D), (3L, 5.0D, -1.0D, 0.0D) AS t(place, px, py, floor)")
    places = places.join(nl.spots(places), "place")
    assert {r["spot"] for r in places.collect()} == {1, 3}
    drawn = spark.sql("SELECT 'n1' AS model, 0L AS draw, * FROM VALUES (1L, 0, 1L), (2L, 0, 2L), (3L, 1, 3L) AS t(id, wall, place)")
    ends = spark.sql("SELECT * FROM VALUES (1L, 1.0D), (3L, 5.0D) AS t(spot, x)").crossJoin(spark.sql("SELECT explode(array(0, 1)) AS wall"))
    sights = ends.crossJoin(ends.selectExpr("spot AS at", "x AS tx", "wall AS at_wall")).selectExpr("spot", "wall", "at", "at_wall", "x AS ex", "-1.0D AS ey", "1.0D AS ez", "tx + 0.5 AS tx", "-1.0D AS ty", "1.0D AS tz", "spot <> 3 AS visible")
    shells = spark.sql("SELECT id, wall, 0 AS tri, 0.2D AS ax, -1.0D AS ay, -9.0D AS az, 0.2D AS bx, 1.0D AS by, -9.0D AS bz, 0.2D AS cx, 0.0D AS cy, 9.0D AS cz FROM VALUES (1L, 0), (2L, 0), (3L, 1) AS t(id, wall)")
    r = nl.counted(drawn, sights, shells, places).first()
    assert (r["pairs"], r["open"], r["v"]) == (6, 4, 0)
