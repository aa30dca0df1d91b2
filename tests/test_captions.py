"""Captions of marks: whole pages, and the operator against all pairs."""

from __future__ import annotations

import math
import random

from oracle import same

from vantage.operators import ledger as lg
from vantage.plans import catalog


def test_a_page_takes_its_captions_from_all_orders(spark, tmp_path):
    spark.createDataFrame([(3,), (20003,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1503,), (1353,), (2855,), (150003,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["captions_near"](spark, str(tmp_path))
    assert {r["mark"]: (r["line"], r["chapel"], r["distance_e6"]) for r in got.collect()}[3] == (1503, 103, 6403124)
    same(got, str(tmp_path), catalog.ORACLES["captions_near"])


def test_captions_as_by_all_pairs(spark):
    rnd = random.Random(3)
    at = lambda: rnd.choice([rnd.uniform(-40, 40), rnd.gauss(5, 0.01), float(rnd.randrange(-9, 9)), -0.0, 7.5])
    some = lambda x, share: x if rnd.random() > share else None
    marks = [(some(rnd.randrange(250), 0.02), some(rnd.randrange(3), 0.02), some(at(), 0.02), at()) for _ in range(300)]
    captions = [(rnd.randrange(500), some(rnd.randrange(4), 0.02), at(), some(at(), 0.02), some(rnd.randrange(9), 0.8)) for _ in range(900)]
    captions += [(k, 0, 5.0, 5.0, None) for k in range(900)] + [(k, 4, 200.0, 200.0, None) for k in range(9)]
    marks += [(251, 4, 200.0, 207.5), (252, 4, 200.0, 207.6), (253, 5, 0.0, 0.0)] + [(254 + k, 0, 5.0, 5.0) for k in range(300)]
    expected = {}
    for mark, page, cx, cy in marks:
        for line, there, x, y, chapel in captions:
            if None in (page, cx, cy, there, x, y) or page != there or (d := math.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) > 7.5:
                continue
            found = (chapel is None, d, line, chapel or 0, chapel)
            expected[mark] = min(expected.get(mark, found), found)
    m, c = spark.createDataFrame(marks, "mark long, page long, cx double, cy double"), spark.createDataFrame(captions, "line long, page long, x double, y double, chapel long")
    got = lg.nearest_caption(m, c, "page", 7.5).collect()
    assert len(got) == len(expected) > 400 and {k[0] for k in expected.values()} == {True, False}
    assert {r["mark"]: (r["line"], r["chapel"], r["distance"]) for r in got} == {k: (f[2], f[4], f[1]) for k, f in expected.items()}
    assert lg.nearest_caption(m, c.where("line < 0"), "page", 7.5).count() == lg.nearest_caption(m.where("mark < 0"), c, "page", 7.5).count() == 0
