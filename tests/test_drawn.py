"""Curves as chords, scanned plans, stored tiles, scene variants."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from vantage.operators import curves as cv
from vantage.operators import plates as pl
from vantage.operators import variants as vr
from vantage.operators.grid import Grid
from vantage.operators.mesh import box_triangles
from vantage.sources import readers as r
from vantage.sources import tilestore as ts


def entities(spark, tmp_path, text: str):
    (tmp_path / "d.dxf").write_text("0\nSECTION\n2\nENTITIES\n" + text + "0\nENDSEC\n")
    return r.dxf_entities(r.numbered_lines(spark, str(tmp_path / "d.dxf")))


def test_chords_keep_to_their_arc(spark, tmp_path):
    """A quarter arc over the zero angle, a circle, and a bulge of one as half a circle; no end off its circle, no middle off by more than the tolerance."""
    text = "0\nARC\n10\n1\n20\n2\n40\n10\n50\n315\n51\n45\n0\nCIRCLE\n10\n0\n20\n0\n40\n3\n0\nLWPOLYLINE\n70\n0\n10\n0\n20\n0\n42\n1\n10\n4\n20\n0\n"
    got = cv.chords(cv.pieces(entities(spark, tmp_path, text), ["file", "entity"]), 0.01).orderBy("entity", "piece", "seg").collect()
    for kind, (x, y), radius, turn in (("ARC", (1, 2), 10, math.pi / 2), ("CIRCLE", (0, 0), 3, 2 * math.pi), ("LWPOLYLINE", (2, 0), 2, math.pi)):
        own = [s for s in got if s["kind"] == kind]
        for s in own:
            assert math.hypot(s["ax"] - x, s["ay"] - y) == pytest.approx(radius) and math.hypot(s["bx"] - x, s["by"] - y) == pytest.approx(radius)
            assert radius - math.hypot((s["ax"] + s["bx"]) / 2 - x, (s["ay"] + s["by"]) / 2 - y) <= 0.01 + 1e-9
        assert all(a["bx"] == pytest.approx(b["ax"]) and a["by"] == pytest.approx(b["ay"]) for a, b in zip(own, own[1:]))
        length = sum(math.hypot(s["bx"] - s["ax"], s["by"] - s["ay"]) for s in own)
        assert 0.99 * radius * turn < length < radius * turn
    # counter-clockwise from (0, 0) to (4, 0): below the line
    assert min(s["ay"] for s in got if s["kind"] == "LWPOLYLINE") < -1.9


def test_odd_entities(spark, tmp_path):
    """Words for numbers, missing ends, circles without radius, rings of one vertex and bulges without length give no piece; the closing side comes once."""
    text = "0\nLINE\n10\nx\n20\n0\n11\n1\n21\n1\n0\nLINE\n10\n1\n20\n0\n0\nCIRCLE\n10\n0\n20\n0\n40\n0\n0\nLWPOLYLINE\n70\n1\n10\n5\n20\n5\n0\nSPLINE\n10\n1\n0\nLWPOLYLINE\n70\n1\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n1\n0\nLWPOLYLINE\n10\n2\n20\n2\n42\n0.5\n10\n2\n20\n2\n"
    p = cv.pieces(entities(spark, tmp_path, text), ["file", "entity"])
    assert p.count() == 4
    got = cv.chords(p, 0.1).orderBy("piece").collect()
    assert [(s["ax"], s["ay"], s["bx"], s["by"], s["layer"]) for s in got] == [(0, 0, 1, 0, "0"), (1, 0, 1, 1, "0"), (1, 1, 0, 0, "0")]
    one = [F.lit(float(v)) for v in (0, 2, -2, 0, 10, 20)]
    assert [(s["ax"], s["ay"]) for s in cv.moved(cv.chords(p, 0.1), one).orderBy("piece").collect()] == [(10, 20), (10, 22), (8, 22)]
    with pytest.raises(Exception, match="too many chords"):
        cv.chords(cv.pieces(entities(spark, tmp_path, "0\nCIRCLE\n10\n0\n20\n0\n40\n1e9\n"), ["file", "entity"]), 1e-6).collect()


def test_plates_without_scale_or_ink(spark):
    """A frame four cells thick is found, its copy with a wrong extent is not, and a blank plate has a row of nulls; ink given twice counts once."""
    frame = [(y, x) for y in range(60) for x in range(60) if min(y, x, 59 - y, 59 - x) < 4]
    ink = spark.createDataFrame([(p, y, x) for p in (1, 2) for y, x in frame * 2], "p int, r int, c int")
    plates = spark.createDataFrame([(1, 0, 80, 0, 80, 20.0, 3.0), (2, 0, 80, 0, 80, 20.0, 30.0), (3, 0, 80, 0, 80, 20.0, 3.0)], "p int, r0 int, r1 int, c0 int, c1 int, ppm double, traced double")
    got = {x["p"]: x for x in pl.plate_thickness(ink, plates, ["p"]).collect()}
    assert got[1]["thickness"] == pytest.approx(0.2) and got[1]["iqr"] == 0 and got[1]["n"] == 4 * 32
    assert got[2]["thickness"] is None and got[2]["ratio"] == pytest.approx(0.0983, abs=1e-3)
    assert got[3]["thickness"] is None and got[3]["ratio"] is None and len(got) == 3


def test_tiles_round_trip_and_pruning(spark, tmp_path):
    """All cells come back, nulls and missing ones as null; a window opens the tiles that it meets and no others, as does a filter where these are pushed."""
    grid = Grid(x0=100.0, y0=50.0, a=0.5, e=-0.5, h=37, w=53)
    heights = spark.range(37 * 53).select((F.col("id") / 53).cast("int").alias("r"), (F.col("id") % 53).cast("int").alias("c"), F.when(F.col("id") % 7 > 0, F.col("id") * 0.25).alias("z")).where("r <> 5")
    path = str(tmp_path / "tiles")
    ts.write_tiles(heights, grid, path, 10)
    assert ts.grid_of(path) == grid
    back = ts.read_tiles(spark, path)
    assert back.count() == 37 * 53 and back.where("r = 5 AND z IS NOT NULL").isEmpty()
    assert back.where("r <> 5").exceptAll(heights).isEmpty() and heights.exceptAll(back).isEmpty()
    part = ts.read_tiles(spark, path, (8, 12, 45, 99))
    assert part.rdd.getNumPartitions() == 2 * 2 and part.count() == 5 * 8
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = ts.read_tiles(spark, path).where("r >= 30 AND c < 10 AND z > 0")
        assert some.rdd.getNumPartitions() == 1 and some.count() == heights.where("r >= 30 AND c < 10 AND z > 0").count()
        assert ts.read_tiles(spark, path).where("r > 36").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    with pytest.raises(FileExistsError):
        ts.write_tiles(heights, grid, path, 10)
    with pytest.raises(Exception, match="sentinel"):
        ts.write_tiles(heights.withColumn("z", F.lit(-9999.0)), grid, str(tmp_path / "bad"), 10)
    with pytest.raises(FileNotFoundError):
        ts.header(str(tmp_path / "bad"))
    ts.write_tiles(heights.limit(0), Grid(h=3, w=3), str(tmp_path / "none"), 10)
    assert ts.read_tiles(spark, str(tmp_path / "none")).where("z IS NULL").count() == 9


def test_variants_march_only_what_changed(spark):
    """A wall, a mound and both, against full runs; rays that pass neither are not marched again, and a hole in the data counts as a change."""
    grid = Grid(h=20, w=20)
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"))
    flat = cells.withColumn("z", F.lit(1.0))
    mound = cells.withColumn("z", F.when((F.col("r") == 10) & (F.col("c") == 10), 9.0).when((F.col("r") == 3) & (F.col("c") == 3), None).otherwise(1.0))
    rays = cells.where("r % 2 = 0").select("r", "c", F.lit(1.5).alias("ex"), F.lit(-10.4).alias("ey"), F.lit(2.6).alias("ez"), (F.col("c") + 0.5).alias("tx"), (-F.col("r") - 0.5).alias("ty"), F.lit(1.2).alias("tz"))
    wall = box_triangles(spark.createDataFrame([(1, 6.2, -7.1, 6.4, -5.3)], "id int, x0 double, y0 double, x1 double, y1 double"), F.lit(0.0), F.lit(4.0)).withColumn("part", F.lit("wall"))
    variants = {"plain": ("flat", ()), "wall": ("flat", ("wall",)), "mound": ("mound", ()), "both": ("mound", ("wall",)), "same": ("flat", ())}
    surfaces = {"flat": flat, "mound": mound}
    got = vr.variant_sights(rays, ["r", "c"], grid, surfaces, wall, variants)
    full = vr.scene_sights(rays.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))), ["r", "c"], grid, surfaces, wall, variants)
    assert got.count() == full.count() == 5 * 200
    assert got.drop("again").exceptAll(full).isEmpty()
    again = {x["variant"]: (x["n"], x["seen"]) for x in got.groupBy("variant").agg(F.count_if("again").alias("n"), F.count_if("visible").alias("seen")).collect()}
    assert again["same"] == (0, again["plain"][1]) and 0 < again["wall"][0] < 100 and 0 < again["mound"][0] < 150
    assert again["wall"][1] < again["plain"][1] and again["both"][1] < again["wall"][1]
    assert vr.variant_sights(rays.limit(0), ["r", "c"], grid, surfaces, wall, variants).isEmpty()
