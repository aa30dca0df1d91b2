"""Operators against values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vantage.functions import text as t
from vantage.operators import grid as g
from vantage.operators import mesh as ms
from vantage.operators import metrics as m
from vantage.operators import sequence as q
from vantage.operators import stats as st
from vantage.operators import visibility as v


@pytest.fixture(scope="module")
def flat(spark):
    cells = [(r, c, 0.0 if (r, c) != (10, 12) else 5.0) for r in range(24) for c in range(24)]
    return spark.createDataFrame(cells, "r int, c int, z double")


def test_bilinear_is_exact_on_a_plane(spark):
    cells = spark.createDataFrame([(r, c, 2.0 * r + 3.0 * c) for r in range(6) for c in range(6)], "r int, c int, z double")
    pts = spark.createDataFrame([(1.75, -2.25), (0.2, -0.2), (5.6, -3.0)], "x double, y double")
    got = {r["x"]: r["z"] for r in g.bilinear(pts, g.corners(cells), g.Grid(h=6, w=6)).collect()}
    assert got[1.75] == pytest.approx(2 * 1.75 + 3 * 1.25)
    assert got[0.2] is None and got[5.6] is None


def test_missing_cell_voids_its_four_samples(spark):
    cells = spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else 1.0) for r in range(5) for c in range(5)], "r int, c int, z double")
    assert g.corners(cells).count() == 16 - 4


def test_peak_hides_what_is_behind_it(spark, flat):
    eye = dict(ex=2.5, ey=-10.5, ez=1.5)
    rays = spark.createDataFrame([(1, 20.5, -10.5, 0.0), (2, 8.5, -10.5, 0.0), (3, 20.5, -10.5, 9.0), (4, 2.5, -10.5, 0.0), (5, 2.9, -10.5, 0.0)], "k int, tx double, ty double, tz double")
    rays = rays.withColumns({c: F.lit(x) for c, x in eye.items()})
    seen = {r["k"]: r["visible"] for r in v.line_of_sight(rays, g.corners(flat), g.Grid(h=24, w=24), ["k"]).collect()}
    assert seen == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_first_hit_lies_on_the_rising_side(spark, flat):
    rays = spark.createDataFrame([(1, 2.5, -10.5, 1.5, 1.0, 0.0, 0.0, -1.5), (2, 2.5, -10.5, 1.5, -1.0, 0.0, 0.0, -1.5)], "k int, ex double, ey double, ez double, ux double, uy double, slope double, f0 double")
    hit = {r["k"]: r["hit"] for r in v.first_hit(rays, g.corners(flat), g.Grid(h=24, w=24), ["k"], 15.0).collect()}
    assert hit[1] == pytest.approx(9.3) and hit[2] is None


def test_box_blocks_through_but_not_over(spark):
    box = ms.box_triangles(spark.createDataFrame([(1, 4.0, 4.0, 6.0, 6.0)], "id long, x0 double, y0 double, x1 double, y1 double"), F.lit(0.0), F.lit(3.0))
    seg = spark.createDataFrame([(1, 0.0, 5.0, 1.0, 9.0, 5.0, 1.0), (2, 0.0, 5.0, 4.0, 9.0, 5.0, 4.0), (3, 0.0, 5.0, 1.0, 4.02, 5.0, 1.0)], "k int, ex double, ey double, ez double, tx double, ty double, tz double")
    assert {r["k"] for r in ms.blocked(seg, box, ["k"]).collect()} == {1}
    first = {r["k"]: r["t"] for r in ms.mesh_first_hit(seg, box, ["k"]).collect()}
    assert first[1] == pytest.approx(4 / 9)


def test_intervals_and_ring(spark):
    spans = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.5, 3.0), (1, 3.04, 4.0), (1, 6.0, 7.0)], "k int, lo double, hi double")
    merged = q.merge_intervals(spans, ["k"], 0.05)
    assert sorted((r["lo"], r["hi"], r["n"]) for r in merged.collect()) == [(0.0, 4.0, 3), (6.0, 7.0, 1)]
    gaps = sorted((round(r["mid"], 3), r["width"]) for r in q.ring_gaps(merged, ["k"], F.lit(10.0), 0.4, 5.0).collect())
    assert gaps == [(5.0, 2.0), (8.5, 3.0)]


def test_longest_rising(spark):
    row = spark.sql("SELECT array(3L, 1L, 4L, 1L, 5L, 9L, 2L, 6L) AS a, array(2L, 2L) AS b, cast(array() AS array<bigint>) AS c")
    assert tuple(row.select(*(q.longest_rising(F.col(k)) for k in "abc")).first()) == (4, 1, 0)


def test_holm(spark):
    rows = q.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double"), "name", "p").collect()
    assert {r["name"]: round(r["p_holm"], 6) for r in rows} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_chi2_survival(spark):
    got = spark.range(1).select(*(st.chi2_survival(F.lit(x), df) for x, df in ((7.0, 7), (6.0, 6), (0.0, 3), (366.6, 7)))).first()
    assert tuple(got)[:3] == (pytest.approx(0.428880, abs=1e-6), pytest.approx(0.423190, abs=1e-6), 1.0)
    assert got[3] == pytest.approx(3.4e-75, rel=0.02)


def test_confusion_of_nothing(spark):
    rows = spark.createDataFrame([(1, False, False, True), (2, True, True, False)], "k int, a boolean, b boolean, ok boolean")
    got = {r["k"]: (r["agreement_pct"], r["iou"]) for r in m.confusion(rows, ["k"], F.col("a"), F.col("b"), F.col("ok")).collect()}
    assert got == {1: (100.0, 1.0), 2: (0.0, 1.0)}


def test_opening_on_a_wall_too_short(spark):
    kinds = spark.createDataFrame([("door", 0.8, 0.0, 1.8)], "kind string, d_width double, d_sill double, d_head double")
    o = spark.createDataFrame([("door", 0.1, None, None, None, 0.5, 10.0, 11.0)], "kind string, s double, width double, sill double, head double, length double, ground double, roof double")
    r = m.opening_rectangle(kinds, o).first()
    assert r["s"] == pytest.approx(0.05) and r["z1"] == pytest.approx(10.9)


def test_text_rules(spark):
    one = spark.createDataFrame([("A  b. Two windows; then\nmore",)], "x string")
    assert one.select(t.sentences(F.col("x"))).first()[0] == ["A b.", "Two windows;", "then more"]
    assert one.select(t.first_count(F.col("x"), "window")).first()[0] == 2
    said = spark.createDataFrame([("north-east",), ("S.W.",), ("-90",), ("x",), (None,)], "d string")
    assert [r[0] for r in said.select(t.direction_degrees(F.col("d"))).collect()] == [45.0, 225.0, 270.0, None, None]


def test_wrapped_bearing(spark):
    r = spark.range(1).select(v.wrapped(F.lit(350.0), F.lit(10.0)), v.bearing(F.lit(-1.0), F.lit(0.0))).first()
    assert r[0] == 20.0 and math.isclose(r[1], 270.0)


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "r int, c int, z double")
    eyes = spark.createDataFrame([], "eye long, ex double, ey double, ez double")
    assert v.viewshed(eyes, cells, g.corners(cells), g.Grid(), 5.0).count() == 0
    assert q.merge_intervals(spark.createDataFrame([], "k int, lo double, hi double"), ["k"]).count() == 0


def test_rings():
    from vantage.operators import polygons as pg

    rough = [(0.0, 0.0), (0.02, 2.0), (0.0, 4.0), (3.0, 4.05), (6.0, 4.0), (6.0, 0.1), (5.9, 0.0)]
    assert pg.wall_ring(rough) == [(0.0, 0.0), (5.9, 0.0), (6.0, 4.0), (0.0, 4.0)]
    shape = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    cut = pg.ears(shape)
    assert len(cut) == 3 and sum(abs(pg._signed([shape[i] for i in t])) for t in cut) == pytest.approx(abs(pg._signed(shape)))


def test_sun_arcs(spark):
    from vantage.functions.angles import bin_shares, sun_arcs

    shares = spark.range(1).select(bin_shares(sun_arcs(F.lit(25.5)))).first()[0]
    assert sum(shares) == pytest.approx(1) and shares[0] == 0 and shares[2] == pytest.approx(shares[6])


def test_observers_see_each_other_unless_a_peak_stands_between(spark, flat):
    eyes = spark.createDataFrame([(1, 8.5, -10.5, 1.5), (2, 16.5, -10.5, 1.5), (3, 8.5, -14.5, 1.5)], "eye int, ex double, ey double, ez double")
    got = {(r["eye"], r["other"]): (r["visible"], round(r["distance"], 3)) for r in v.observer_edges(eyes, g.corners(flat), g.Grid(h=24, w=24), 8.0).collect()}
    assert got == {(1, 1): (True, 0), (2, 2): (True, 0), (3, 3): (True, 0), (1, 2): (False, 8), (2, 1): (False, 8), (1, 3): (True, 4), (3, 1): (True, 4)}


def test_large_surfaces_are_joined_with_the_same_result(spark, monkeypatch):
    import random

    rng = random.Random(3)
    cells = spark.createDataFrame([(r, c, None if rng.random() < 0.03 else rng.random() * 6) for r in range(30) for c in range(30)], "r int, c int, z double")
    rays = spark.createDataFrame([(k, *(v for _ in range(2) for v in (rng.random() * 36 - 3, -rng.random() * 36 + 3, rng.random() * 9))) for k in range(400)] + [(400, 3.0, -3.0, 1.0, 3.0, -3.0, 2.0), (401, 3.0, -3.0, 1.0, 9.0, -9.0, None)], "k int, ex double, ey double, ez double, tx double, ty double, tz double")
    grid = g.Grid(h=30, w=30)
    marched = {r["k"]: (r["visible"], r["dist"]) for r in v.line_of_sight(rays, g.corners(cells), grid, ["k"]).collect()}
    monkeypatch.setattr(v, "small_surface", lambda four: None)
    joined = {r["k"]: (r["visible"], r["dist"]) for r in v.line_of_sight(rays, g.corners(cells), grid, ["k"]).collect()}
    assert marched == joined and 50 < sum(x for x, _ in marched.values()) < 350


def test_permutations_are_not_rotations(spark):
    """Draws of one seed differ in what stands next to what, and each label is dealt once."""
    rows = spark.range(60).select(F.col("id"), F.col("id").alias("label"))
    dealt = {}
    for r in st.permuted(rows, "id", "label", 6, 3).collect():
        dealt.setdefault(r["draw"], {})[r["id"]] = r["other"]
    assert all(sorted(d.values()) == list(range(60)) for d in dealt.values())
    follows = [{(d[k], d[k + 1]) for k in range(59)} for d in dealt.values()]
    assert all(len(a & b) < 12 for i, a in enumerate(follows) for b in follows[:i])
    assert all(sum(d[k + 1] > d[k] for k in range(59)) < 45 for d in dealt.values())


def test_closed_buildings_of_any_ring():
    """Rectangles and bent rings with doors, windows over each other and pockets: no odd edge, and the walls' volume."""
    from collections import Counter

    import numpy as np

    from vantage.operators import buildings as b

    def volume(t):
        t = np.array(t)
        return float((t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum() / 6)

    def odd(t):
        edges = Counter(frozenset((tri[i], tri[(i + 1) % 3])) for tri in ([tuple(round(v * 1e6) for v in p) for p in x] for x in t) for i in range(3))
        return sum(n % 2 for n in edges.values())

    holes = [(0, 1, 1.9, 0.05, 2.0, None), (1, 0.8, 1.4, 1, 1.6, None), (1, 1.1, 1.7, 1.8, 2.2, None), (2, 0.7, 1.3, 0.9, 1.3, 0.15), (3, 0.75, 1.25, 0.5, 1.1, 0.1)]
    cut = 0.3 * (0.9 * 1.95 + 0.36 + 0.24) + 0.24 * 0.15 + 0.3 * 0.1
    t = b.solid([(0, 0), (5, 0), (5, 4), (0, 4)], holes, 0.3, (3.0, -0.1, 0.05), 0.2)
    assert not odd(t) and volume(t) == pytest.approx(20 * 2.85 - 4.4 * 3.4 * 2.65 - cut)
    bent = [(0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6)]
    t = b.solid(bent, holes, 0.3, (3.0, 0.0, 0.0), 0.2)
    inner = 5.4 * 2.4 + 2.4 * 3.0
    assert not odd(t) and volume(t) == pytest.approx(27 * 3 - inner * 2.8 - cut)
    d = b.dome(0.0, 0.0, 2.0, 1.5, 48, 24)
    assert not odd(d) and volume(d) == pytest.approx(2 / 3 * np.pi * 1.5**3, rel=0.01)


def test_volume_mesh_goes_to_a_file(spark, tmp_path):
    """Three voxels as an indexed mesh: numbers without gaps, turned outwards, warped to the ground, written as PLY."""
    from vantage.operators import raster as ra
    from vantage.sources import writers as w

    voxels = spark.createDataFrame([(2, 3, 0), (2, 4, 0), (3, 3, 0), (2, 3, 0)], "r int, c int, l int").distinct()
    vertices, faces = ms.indexed_mesh(voxels)
    assert sorted(r["v"] for r in vertices.collect()) == list(range(16)) and faces.count() == 28
    n = ms.mesh_numbers(vertices.select("v", F.col("c").alias("x"), (-F.col("r")).alias("y"), F.col("l").alias("z")), faces).first()
    assert (n["euler"], n["odd"], n["unpaired"]) == (2, 0, 0) and n["volume"] == pytest.approx(3.0)
    ground = spark.createDataFrame([(r, c, 10.0 + c) for r in range(8) for c in range(8)], "r int, c int, z double")
    placed = ra.to_world(vertices.select("v", *(F.col(x).cast("double").alias(x) for x in "rcl")), g.corners(ground), g.Grid(h=8, w=8), 0.5, 2.0)
    assert {(r["x"], r["z"]) for r in placed.where("l = 0").collect()} == {(3.5, 13.5), (4.5, 14.5), (5.5, 15.5)}
    w.write_lines(w.ply_mesh(placed.select("v", "x", "y", "z"), faces), str(tmp_path / "mesh"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "mesh")).collect()]
    assert lines[2] == "element vertex 16" and lines[6] == "element face 28" and len(lines) == 9 + 16 + 28


def test_planes_of_whole_numbers_round_as_they_are(spark, tmp_path):
    """The plane through these three orders has a constant of -11.90625 exactly, so half a ten thousandth goes to the even one."""
    from vantage.plans import catalog

    spark.createDataFrame([(k, 1) for k in (7818671, 7851647, 7915351)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    r = catalog.QUERIES["roof_planes"](spark, str(tmp_path)).first()
    assert (r["n"], r["a"], r["b"], r["c"]) == (3, 8438, 4531, -119062)
