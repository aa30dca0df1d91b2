"""Sources and sinks round trip."""

from __future__ import annotations

import zlib

import pytest

from vantage.sources import readers as r
from vantage.sources import writers as w


def test_obj_fans_and_negative_numbers(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# box\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n")
    v, f = r.obj_mesh(r.numbered_lines(spark, str(tmp_path / "m.obj")))
    assert v.count() == 4
    assert [(x["a"], x["b"], x["d"]) for x in f.orderBy("line_no", "k").collect()] == [(0, 1, 2), (0, 2, 3), (0, 1, 2)]
    w.write_lines(w.obj_lines(v, f), str(tmp_path / "out"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == "v 0.0000 0.0000 0.0000" and lines[-1].startswith("f ") and len(lines) == 7


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,t\n1,0.5\nx,0.5\n2,\n")
    rows = r.strings_csv(spark, str(tmp_path / "a.csv"), ["ID", "t"])
    good, bad = r.typed(rows, {"ID": "int", "t": "double"}, ["ID"])
    assert sorted(map(tuple, good.collect())) == [(1, 0.5), (2, None)] and [x["ID"] for x in bad.collect()] == ["x"]
    assert r.strings_csv(spark, str(tmp_path / "none.csv"), ["ID"]).count() == 0


def test_dxf(spark, tmp_path):
    (tmp_path / "d.dxf").write_text("0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nWALLS\n10\n1.0\n20\n2.0\n0\nHATCH\n8\nX\n0\nENDSEC\n")
    e = r.dxf_entities(r.numbered_lines(spark, str(tmp_path / "d.dxf"))).collect()
    assert len(e) == 1 and e[0]["kind"] == "LINE" and [(t["code"], t["value"]) for t in e[0]["tags"]] == [(0, "LINE"), (8, "WALLS"), (10, "1.0"), (20, "2.0")]


def test_pdf_streams(spark, tmp_path):
    body = b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (x) Tj ET") + b"\nendstream\nstream\n\xff\xd8\xffraw\nendstream\n"
    (tmp_path / "p.pdf").write_bytes(body)
    streams = r.pdf_streams(spark.read.format("binaryFile").load(str(tmp_path / "p.pdf")))
    assert [bytes(x["content"]) for x in streams.orderBy("stream").collect()] == [b"BT (x) Tj ET", b"\xff\xd8\xffraw"]
    assert r.jpeg_spans(streams).count() == 1


def test_manifest_pages_and_digest(spark, tmp_path):
    (tmp_path / "page_007.txt").write_text("one\ntwo")
    assert r.page_texts(spark, str(tmp_path / "page_007.txt")).first()["page"] == 7
    lines = spark.createDataFrame([("ab12  file one",), ("",)], "line string")
    assert [tuple(x) for x in r.manifest(lines).collect()] == [("file one", "ab12")]
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert w.digest(a) == w.digest(a.orderBy(a.k.desc())) != w.digest(a.where("k = 1"))


def test_report_and_merge(spark, tmp_path):
    a = spark.createDataFrame([(1, "old")], "k int, v string")
    w.merge_into(a, spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string"), ["k"], ["k", "v"], str(tmp_path / "m"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [(1, "old"), (2, "a")]
    assert w.markdown(a) == "| k | v |\n|---|---|\n| 1 | old |"
    with pytest.raises(ValueError):
        w.markdown(spark.range(3), 2)


def test_page_marks_follow_the_pen(spark):
    from vantage.sources import drawings as d

    content = b"q\n2 0 0 2 10 20 cm\n1 1 m\n3 1 l\n3 4 l\nh\nQ\n0 0 m\n5 0 l\nBT\n1 0 0 1 7 8 Tm\n[<00410042> 3 <0043>] TJ\nET\n9 9 xx\nBT\nET\n"
    streams = spark.createDataFrame([("p", 0, bytearray(content)), ("p", 1, None)], "path string, stream int, content binary")
    rows = d.page_marks(streams, {0x41: "A", 0x42: "B"}).collect()
    assert [(r["ax"], r["ay"], r["bx"], r["by"]) for r in rows if r["kind"] == "segment"] == [(12, 22, 16, 22), (16, 22, 16, 28), (16, 28, 12, 22), (0, 0, 5, 0)]
    assert [(r["text"], r["ax"], r["ay"]) for r in rows if r["kind"] == "label"] == [("AB\ufffd", 7, 8)]


def test_page_marks_by_tokens():
    """Several operators in a line, comments, strings with brackets, rectangles, curves' chords, moved text, and what is no number."""
    from vantage.sources import drawings as d

    content = b"q 1 0 0 1 5 5 cm 0 0 m 1 0 l (a \\) (b) l 9) Tj S Q % 7 7 l\n1 2 3 4 re x.y 4 l 0 0 m 1 1 2 2 9 3 c h\nBT 3 4 Td 1 1 TD <0041>Tj [<00 42> -20 <0043>]TJ ET 5 l"
    got = list(d.marks_of(content, {0x41: "A", 0x42: "B", 0x43: "C"}))
    assert [m[2:] for m in got if m[0] == "segment"] == [(5, 5, 6, 5), (1, 2, 4, 2), (4, 2, 4, 6), (4, 6, 1, 6), (1, 6, 1, 2), (0, 0, 9, 3), (9, 3, 0, 0)]
    assert [m[1:4] for m in got if m[0] == "label"] == [("ABC", 4, 5)]


def test_vector_tables(spark):
    from vantage.sources import drawings as d

    p = spark.createDataFrame([(7, [(1.0, 2.0), (3.0, 4.0)]), (9, [(5.0, 6.0)])], "Id long, parts array<struct<x:double,y:double>>")
    assert sorted(map(tuple, d.points(p, "ID", "parts", ["Id"]).collect())) == [(7, 1.0, 2.0), (7, 3.0, 4.0), (9, 5.0, 6.0)]
    assert sorted(r["id"] for r in d.points(p, None, "parts", ["Id"]).collect()) == [1, 1, 2]
    ring = spark.createDataFrame([(1, [[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], [(0.0, 0.0)]])], "id long, rings array<array<struct<x:double,y:double>>>")
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in d.polygon_edges(ring, "id", "rings").orderBy("e").collect()] == [(0, 0, 2, 0), (2, 0, 0, 2), (0, 2, 0, 0)]
    sheet = spark.createDataFrame([("12", "A "), ("x", "B"), ("3.5", "C"), ("4.0", " ")], "` Chapel # ` string, TYPE string")
    assert sorted(map(tuple, d.typology(sheet, "chapel #", "type").collect())) == [(4, None), (12, "A")]
    flags = spark.createDataFrame([(" True",), ("no",), (None,)], "f string")
    assert [r[0] for r in flags.select(d.is_true(flags.f)).collect()] == [True, False, False]


def test_meshes_volumes_and_checkpoints(spark, tmp_path):
    from vantage.operators import ledger as lg

    grid = spark.createDataFrame([(r, c, None if (r, c) == (0, 0) else float(r + c)) for r in range(3) for c in range(3)], "r int, c int, z double")
    w.write_lines(w.terrain_obj(grid, 2), str(tmp_path / "t"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == ["v 0.0000 0.0000 2.0000", "v 2.0000 0.0000 2.0000", "v 0.0000 -2.0000 2.0000", "v 2.0000 -2.0000 4.0000", "f 1 3 2", "f 2 3 4"]
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "v long, x double, y double, z double")
    w.write_lines(w.ply_mesh(v, spark.createDataFrame([(0, 1, 2)], "a int, b int, d int")), str(tmp_path / "p"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "p")).collect()]
    assert lines[2] == "element vertex 3" and lines[6] == "element face 1" and lines[-1] == "3 0 1 2"
    w.write_volume(grid.withColumn("l", grid.r), str(tmp_path / "v"), {"x0": 1.5, "crs": "local"})
    assert spark.read.parquet(str(tmp_path / "v/cells")).count() == 9 and spark.read.text(str(tmp_path / "v/about")).first()[0] == '{"crs":"local","x0":1.5}'
    mark = lg.fingerprint({"radius": 5, "draws": 9})
    w.checkpoint(grid, str(tmp_path / "c"), mark)
    saved = spark.read.parquet(str(tmp_path / "c"))
    assert lg.resume(saved, lg.fingerprint({"draws": 9, "radius": 5})).count() == 9
    with pytest.raises(Exception, match="another configuration"):
        lg.resume(saved, lg.fingerprint({"draws": 8, "radius": 5})).collect()
    assert w.report([("A", spark.range(1))]) == "## A\n\n| id |\n|---|\n| 0 |"
