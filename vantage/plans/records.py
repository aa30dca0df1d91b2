"""Queries of the spatial, registry, metric, sequence, text and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions import text as t
from vantage.operators import metrics as m
from vantage.operators import sequence as q
from vantage.operators import spatial as sp
from vantage.operators import stats as st
from vantage.session import table

from .scenes import DEM_SQL, GRID, dem, mixed, rectangles

POINTS_SQL = "pts AS (SELECT c_custkey AS k, c_custkey * 131 % 6007 / 100.0::DOUBLE + 0.003 AS px, -(c_custkey * 293 % 6011 / 100.0::DOUBLE) - 0.003 AS py FROM customer)"
EDGES_SQL = """edges AS (SELECT id, 0 AS e, x0, y0, x1, y0 AS y1 FROM rects UNION ALL SELECT id, 1, x1, y0, x1, y1 FROM rects
  UNION ALL SELECT id, 2, x1, y1, x0, y1 FROM rects UNION ALL SELECT id, 3, x0, y1, x0, y0 FROM rects)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 131 % 6007 / 100.0 + 0.003).alias("px"), (-(F.col("c_custkey") * 293 % 6011 / 100.0) - 0.003).alias("py"))


def _edges(rects):
    corners = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")]
    each = F.array(*(F.struct(F.lit(k).alias("e"), *(F.col(c).alias(n) for c, n in zip(cs, ("x0", "y0", "x1", "y1")))) for k, cs in enumerate(corners)))
    return rects.select("id", F.explode(each).alias("s")).select("id", "s.*")


def radius_pairs(spark, sf_dir):
    """Customers within 1.5 of each supplier's place."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 62 + 1.5).cast("double").alias("lx"), (-(F.col("s_suppkey") * 13 % 62 + 1.5)).cast("double").alias("ly"))
    near = sp.within_radius(s, _points(spark, sf_dir).withColumnsRenamed({"px": "rx", "py": "ry"}), 1.5).where("s_suppkey <> k")
    return near.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.rint(F.min("dist") * 1e6).cast("long").alias("nearest_um"))


def nearest_wall(spark, sf_dir):
    """The nearest wall of any footprint within 0.8 of each customer's place."""
    segments = _edges(rectangles(spark, sf_dir)).withColumn("seg", F.col("id") * 4 + F.col("e"))
    near = sp.nearest_segment(_points(spark, sf_dir), segments, "k", "seg", 0.8)
    return near.select("k", F.rint(F.col("dist") * 1e6).cast("long").alias("dist_um"))


def within_polygon(spark, sf_dir):
    """How many footprints each customer's place lies in, and the first."""
    return sp.polygons_round(_points(spark, sf_dir), _edges(rectangles(spark, sf_dir)), "k", "id").withColumnRenamed("first", "first_id")


def _openings(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    face = F.element_at(F.array(*map(F.lit, ("through", "in", "out"))), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.floor(k / 8).alias("bid"), (k % 2).alias("wall"), k.alias("seq"), (s % 10 * 0.5).alias("s0"), (s % 10 * 0.5 + 0.9).alias("s1"), (s % 3 * 0.5).alias("z0"), (s % 3 * 0.5 + 1.0).alias("z1"), face.alias("face"), (s % 4 * 0.1).alias("depth"), F.lit(0.45).alias("thickness"))


def overlap_conflicts(spark, sf_dir):
    """Openings of one wall that can't both be built."""
    return sp.overlap_conflicts(_openings(spark, sf_dir), ["bid", "wall"], "seq")


def kind_defaults(spark, sf_dir):
    """Opening rectangles in millimetres, blanks filled by kind."""
    kinds = spark.createDataFrame([("door", 0.8, 0.0, 1.8), ("window", 0.6, 0.9, 1.5), ("niche", 0.4, 0.7, 1.2), ("apse", 1.2, 0.0, 2.0)], "kind string, d_width double, d_sill double, d_head double")
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("door", "window", "niche", "apse"))), (k % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "part").select(k.alias("id"), kind.alias("kind"), (s % 11 * 0.4).alias("s"), F.when(k % 3 == 0, s * 0.03125).alias("width"), F.when(k % 5 == 0, s * 0.015625).alias("sill"), F.lit(None).cast("double").alias("head"), (s % 5 + 0.75).cast("double").alias("length"), (k % 7).cast("double").alias("ground"), (k % 7 + 1.75).cast("double").alias("roof"))
    r = m.opening_rectangle(kinds, o)
    mm = lambda c: F.rint(F.col(c) * 1000).cast("long").alias(c + "_mm")
    return r.select("id", "kind", *map(mm, ("s0", "s1", "z0", "z1")))


def baseline_confusion(spark, sf_dir):
    """Agreement of two masks of lines by ship year."""
    rows = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    out = m.confusion(rows, ["year"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_discount") > 0.02)
    return out.select("year", "both", "a_only", "b_only", "neither", F.rint(F.col("agreement_pct") * 1e6).cast("long").alias("agreement_e6"), F.rint(F.col("iou") * 1e6).cast("long").alias("iou_e6"))


def agreement_pivot(spark, sf_dir):
    """Mean quantity of each ship mode's variants side by side, with the steps between them."""
    rows = table(spark, sf_dir, "lineitem").withColumn("variant", F.element_at(F.array(*map(F.lit, ("solid", "door", "roof"))), (F.col("l_linenumber") % 3 + 1).cast("int")))
    wide = m.effects(rows, ["l_returnflag", "l_linestatus"], "variant", "l_quantity", ["solid", "door", "roof"])
    e6 = lambda c: F.rint(F.col(c) * 1e6).cast("long").alias(c)
    return wide.select("l_returnflag", "l_linestatus", *map(e6, ("solid", "door", "roof", "solid_to_door", "door_to_roof")))


def provenance_tally(spark, sf_dir):
    """Order priorities by frequency."""
    return m.tally(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


def provenance_by_entity(spark, sf_dir):
    """Every customer with its orders by status, none counted as 0."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in ("F", "O", "P")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(counts, c.c_custkey == counts.o_custkey, "left").select("c_custkey", "c_mktsegment", *(F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in "fop"))


def undocumented_tokens(spark, sf_dir):
    """Tokens of orders that no customer segment or region name documents."""
    words = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("token")).union(table(spark, sf_dir, "region").select("r_name")).distinct()
    return m.undocumented(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], words)


def registry_merge(spark, sf_dir):
    """Parts of odd keys, and of all parts' brands what they lack, first part each."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    old = q.first_by(parts.where("p_partkey % 2 = 1"), ["p_brand", "p_size"], ["p_partkey"])
    return m.insert_only(old, parts, ["p_brand", "p_size"], ["p_partkey"])


def registry_conflicts(spark, sf_dir):
    """Customers and suppliers of one key with different nations."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return m.conflicts(a, b, ["key"], "nation").select("key", F.col("a").alias("customer_nation"), F.col("b").alias("supplier_nation"))


def manifest_diff(spark, sf_dir):
    """Digests of parts against those of suppliers under the same numbers."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.sha2(F.concat(F.lit("n"), (F.col("p_partkey") % 5).cast("string")), 256).alias("digest"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("name"), F.sha2(F.concat(F.lit("n"), (F.col("s_suppkey") % 5).cast("string")), 256).alias("digest"))
    return m.manifest_diff(old, new)


def thickness_ladder(spark, sf_dir):
    """Wall thickness: measured, else the type's median, else the default."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 16.0).alias("measured"))
    return m.thickness_ladder(rows, "measured", "p_type", 0.5).select("p_partkey", F.rint(F.col("thickness") * 1e6).cast("long").alias("thickness_um"), "source")


def next_ap_ids(spark, sf_dir):
    """Numbers for new lines, going on from each order's highest."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    old = lines.select(F.col("l_orderkey").alias("id"), "n")
    fresh = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit("window"), F.lit("niche"))).alias("kind"))
    return m.next_numbers(fresh, old, "id", "n", ["kind"]).select("id", "kind", F.col("n").cast("long").alias("n"))


def calibration_percentiles(spark, sf_dir):
    """Count, median and quartiles of two fields by brand."""
    p = table(spark, sf_dir, "part")
    long = p.select("p_brand", F.explode(F.array(F.struct(F.lit("size").alias("field"), F.col("p_size").cast("double").alias("v")), F.struct(F.lit("price").alias("field"), F.col("p_retailprice").alias("v")))).alias("f")).select("p_brand", "f.*")
    e3 = lambda p_: F.rint(F.percentile("v", p_) * 1000).cast("long")
    return long.groupBy("p_brand", "field").agg(F.count("*").alias("n"), e3(0.25).alias("q1"), e3(0.5).alias("median"), e3(0.75).alias("q3"))


def interval_merge(spark, sf_dir):
    """Runs of each user's events, each lasting ten minutes, merged where they touch."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("lo"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 600).alias("hi"))
    return q.merge_intervals(e, ["user_id"]).select("user_id", F.col("island").cast("long").alias("island"), "lo", "hi", "n")


def ring_gaps(spark, sf_dir):
    """Gaps of 5 to 300 minutes round the day in each user's merged events."""
    s = F.unix_seconds(F.col("ts").cast("timestamp")) % 86400
    e = table(spark, sf_dir, "events").select("user_id", s.cast("double").alias("lo"), (s + 600).cast("double").alias("hi"))
    gaps = q.ring_gaps(q.merge_intervals(e, ["user_id"], 0.05), ["user_id"], F.lit(86400.0), 300.0, 18000.0)
    return gaps.select("user_id", F.rint(F.col("mid") * 1000).cast("long").alias("mid_ms"), F.rint(F.col("width") * 1000).cast("long").alias("width_ms"))


def first_statement(spark, sf_dir):
    """What each role says first in each conversation."""
    c = table(spark, sf_dir, "conversations")
    return q.first_by(c, ["conv_id", "role"], ["turn", "text"]).select("conv_id", "role", "turn", F.length("text").alias("n_chars"))


def dedupe_prefer_placed(spark, sf_dir):
    """Documents with a source, one each; languages without any keep one that has none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("place"))
    return q.prefer_placed(d, ["lang"], "place", ["doc_id"])


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d


def heading_segments(spark, sf_dir):
    """Lines under each heading, a line of at most five words, of each document."""
    lines = _lines(spark, sf_dir)
    head = F.when(F.size(F.split("line", " ")) <= 5, F.col("line_no"))
    carried = q.carry_headings(lines, ["doc_id"], ["line_no"], head)
    return carried.groupBy("doc_id", "heading_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def carry_over(spark, sf_dir):
    """The last user turn that each assistant turn answers, carried across turns."""
    c = table(spark, sf_dir, "conversations")
    carried = q.carry_headings(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")))
    return carried.where("role = 'assistant'").select("conv_id", "turn", F.col("heading_id").alias("answers"))


def sentence_features(spark, sf_dir):
    """Sentences of each document: how many, the longest, how many are titles."""
    d = table(spark, sf_dir, "documents").select("doc_id", t.sentences(F.coalesce("text", F.lit("")), 2).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"), F.size(F.filter("s", lambda x: t.is_title(x))).cast("long").alias("n_titles"))


def direction_extract(spark, sf_dir):
    """Bearings written in several ways, one for each part."""
    forms = ("north", "N.E.", "south-west", "270", "-45", "West", "unknown", "s")
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("said"))
    return p.select("p_partkey", t.direction_code(F.col("said")).alias("code"), F.rint(t.direction_degrees(F.col("said"))).cast("long").alias("degrees"))


def stated_counts(spark, sf_dir):
    """Counts stated in documents before a small word, with up to three words between."""
    d = table(spark, sf_dir, "documents").select("doc_id", t.first_count(F.coalesce("text", F.lit("")), "(?:of|the|hand)").alias("n"))
    return d.where("n IS NOT NULL")


def longest_rising_run(spark, sf_dir):
    """Length of the longest rising subsequence of text lengths in each conversation, which is bounded by its turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("bigint").alias("n")))).alias("s"))
    return c.select("conv_id", q.longest_rising(F.transform("s", lambda x: x["n"])).cast("long").alias("lis"))


def g_test_classes(spark, sf_dir):
    """G of customers over the first nine nations, and its p-value."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    g = st.g_statistic(n.where("c_nationkey < 9"), 9)
    return g.select(F.rint(F.col("g") * 1e6).cast("long").alias("g_e6"), "n", F.rint(st.chi2_survival(F.col("g"), 8) * 1e9).cast("long").alias("p_e9"))


def mixture_fit(spark, sf_dir):
    """Share of a rising law in the counts of orders by priority."""
    n = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("k")).agg(F.count("*").alias("n"))
    shares = n.select("n", (F.col("k") / 15.0).alias("p1"), F.lit(0.2).alias("p0"))
    return st.mixture_fit(shares, 200).select(F.rint(F.col("w") * 1000).cast("long").alias("w_e3"))


def holm_adjust(spark, sf_dir):
    """Holm's adjustment of one p-value a nation."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(((F.sum("c_custkey") % 997 + 1) / 20000.0).alias("p"))
    return q.holm(n.withColumn("name", F.col("c_nationkey").cast("string")), "name", "p").select("name", F.rint(F.col("p_holm") * 1e9).cast("long").alias("p_holm_e9"), "reject")


def permutation_null(spark, sf_dir):
    """How many suppliers keep their nation under each of 40 permutations."""
    return st.permuted_matches(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", 40)


def sequential_stop(spark, sf_dir):
    """For each customer, after how many orders three were above a price."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("v"), F.lit(150000.0).alias("v0"))
    return st.sequential_stop(o, ["o_custkey"], "o_orderkey", "v0", 3).select("o_custkey", F.col("stopped_at").cast("long").alias("stopped_at"), F.col("reached").cast("long").alias("reached"), F.rint(F.col("p") * 1e9).cast("long").alias("p_e9"))


def topk_seen(spark, sf_dir):
    """The twelve parts with most lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(12)


def stride_sample(spark, sf_dir):
    """Every 97th cell of the grid in row order."""
    return dem(spark, sf_dir).withColumn("i", F.col("r") * GRID.w + F.col("c")).where("i % 97 = 0").select("r", "c", F.col("z").cast("long").alias("z"))


def file_digest(spark, sf_dir):
    """SHA-256 of every document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


def cumulative_starts(spark, sf_dir):
    """Where each line of an order starts, lines laid end to end by quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("len"))
    return q.cumulative_starts(lines, ["l_orderkey"], "l_linenumber", "len")


def robust_line(spark, sf_dir):
    """A line through parts' points, found in spite of every 13th, which is far off."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select((k % 97).cast("double").alias("x"), (3.0 * (k % 97) + 7 + (k % 5 - 2) * 0.25 + F.when(k % 13 == 0, 500.0).otherwise(0.0)).alias("y"))
    slope, icept, n = st.fit_line_mad(p, 10)
    return spark.createDataFrame([(round(slope * 1e4), round(icept * 1e4), n)], "slope_e4 long, intercept_e4 long, n long")


QUERIES = {f.__name__: f for f in (
    radius_pairs, nearest_wall, within_polygon, overlap_conflicts, kind_defaults, baseline_confusion, agreement_pivot, provenance_tally, provenance_by_entity, undocumented_tokens,
    registry_merge, registry_conflicts, manifest_diff, thickness_ladder, next_ap_ids, calibration_percentiles, interval_merge, ring_gaps, first_statement, dedupe_prefer_placed,
    heading_segments, carry_over, sentence_features, direction_extract, stated_counts, longest_rising_run, g_test_classes, mixture_fit, holm_adjust, permutation_null, sequential_stop,
    topk_seen, stride_sample, file_digest, cumulative_starts, robust_line,
)}
ORACLES = {
    "radius_pairs": f"""WITH {POINTS_SQL}, s AS (SELECT s_suppkey, s_suppkey * 7 % 62 + 1.5::DOUBLE AS x, -(s_suppkey * 13 % 62 + 1.5::DOUBLE) AS y FROM supplier),
      d AS (SELECT s_suppkey, k, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS dist FROM s, pts)
      SELECT s_suppkey, count(*) AS n, CAST(round_even(min(dist) * 1e6, 0) AS BIGINT) AS nearest_um FROM d WHERE dist <= 1.5 AND s_suppkey <> k GROUP BY 1""",
    "nearest_wall": f"""WITH {DEM_SQL}, {POINTS_SQL}, {EDGES_SQL}, near AS (
      SELECT k, px, py, x0, y0, x1, y1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0), 0))) AS t
      FROM pts JOIN edges ON px >= least(x0, x1) - 0.8 AND px <= greatest(x0, x1) + 0.8 AND py >= least(y0, y1) - 0.8 AND py <= greatest(y0, y1) + 0.8
    ), dist AS (SELECT k, sqrt((px - (x0 + t * (x1 - x0))) * (px - (x0 + t * (x1 - x0))) + (py - (y0 + t * (y1 - y0))) * (py - (y0 + t * (y1 - y0)))) AS d FROM near)
    SELECT k, CAST(round_even(min(d) * 1e6, 0) AS BIGINT) AS dist_um FROM dist WHERE d <= 0.8 GROUP BY k""",
    "within_polygon": f"WITH {DEM_SQL}, {POINTS_SQL} SELECT k, count(*) AS n, min(id) AS first_id FROM pts JOIN rects ON px > x0 AND px < x1 AND py > y0 AND py < y1 GROUP BY k",
    "overlap_conflicts": """WITH o AS (SELECT p_partkey // 8 AS bid, p_partkey % 2 AS wall, p_partkey AS seq, p_size % 10 * 0.5::DOUBLE AS s0, p_size % 10 * 0.5::DOUBLE + 0.9::DOUBLE AS s1,
        p_size % 3 * 0.5::DOUBLE AS z0, p_size % 3 * 0.5::DOUBLE + 1 AS z1, ['through', 'in', 'out'][p_partkey % 3 + 1] AS face, p_size % 4 * 0.1::DOUBLE AS depth FROM part)
      SELECT a.bid, a.wall, a.seq AS a_seq, b.seq AS b_seq FROM o a JOIN o b ON a.bid = b.bid AND a.wall = b.wall AND a.seq < b.seq
      AND least(a.s1, b.s1) - greatest(a.s0, b.s0) > 0.01::DOUBLE AND least(a.z1, b.z1) - greatest(a.z0, b.z0) > 0.01::DOUBLE
      AND CASE WHEN a.face <> 'through' AND b.face <> 'through' AND a.face <> b.face THEN a.depth + b.depth >= 0.45::DOUBLE ELSE true END""",
    "kind_defaults": """WITH kinds AS (SELECT * FROM (VALUES ('door', 0.8::DOUBLE, 0.0::DOUBLE, 1.8::DOUBLE), ('window', 0.6, 0.9, 1.5), ('niche', 0.4, 0.7, 1.2), ('apse', 1.2, 0.0, 2.0)) k(kind, dw, ds, dh)),
      o AS (SELECT p_partkey AS id, ['door', 'window', 'niche', 'apse'][p_partkey % 4 + 1] AS kind, p_size % 11 * 0.4::DOUBLE AS s, CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.03125::DOUBLE END AS width,
        CASE WHEN p_partkey % 5 = 0 THEN p_size * 0.015625::DOUBLE END AS sill, p_size % 5 + 0.75::DOUBLE AS length, CAST(p_partkey % 7 AS DOUBLE) AS ground FROM part),
      f AS (SELECT id, kind, coalesce(width, dw) AS w, ground, length, s, coalesce(sill, ds) AS sill, dh FROM o JOIN kinds USING (kind)),
      p AS (SELECT *, least(greatest(s, w / 2 + 0.05::DOUBLE), length - (w / 2 + 0.05::DOUBLE)) AS pos FROM f)
      SELECT id, kind, CAST(round_even((pos - w / 2) * 1000, 0) AS BIGINT) AS s0_mm, CAST(round_even((pos + w / 2) * 1000, 0) AS BIGINT) AS s1_mm, CAST(round_even((ground + sill) * 1000, 0) AS BIGINT) AS z0_mm,
        CAST(round_even(least(ground + dh, ground + 1.75 - 0.1::DOUBLE) * 1000, 0) AS BIGINT) AS z1_mm FROM p""",
    "baseline_confusion": """WITH r AS (SELECT year(l_shipdate) AS year, l_returnflag = 'R' AS a, l_linestatus = 'F' AS b FROM lineitem WHERE l_discount > 0.02::DOUBLE),
      k AS (SELECT year, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM r GROUP BY year)
      SELECT CAST(year AS INTEGER) AS year, "both", a_only, b_only, neither, CAST(round_even(("both" + neither) * 100.0::DOUBLE / ("both" + a_only + b_only + neither) * 1e6, 0) AS BIGINT) AS agreement_e6,
        CAST(round_even(coalesce("both" * 1.0::DOUBLE / nullif("both" + a_only + b_only, 0), 1) * 1e6, 0) AS BIGINT) AS iou_e6 FROM k""",
    "agreement_pivot": """WITH v AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) FILTER (l_linenumber % 3 = 0) AS s, avg(l_quantity) FILTER (l_linenumber % 3 = 1) AS d, avg(l_quantity) FILTER (l_linenumber % 3 = 2) AS r FROM lineitem GROUP BY 1, 2)
      SELECT l_returnflag, l_linestatus, CAST(round_even(s * 1e6, 0) AS BIGINT) AS solid, CAST(round_even(d * 1e6, 0) AS BIGINT) AS door, CAST(round_even(r * 1e6, 0) AS BIGINT) AS roof,
        CAST(round_even((d - s) * 1e6, 0) AS BIGINT) AS solid_to_door, CAST(round_even((r - d) * 1e6, 0) AS BIGINT) AS door_to_roof FROM v""",
    "provenance_tally": """WITH c AS (SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1)
      SELECT o_orderpriority, n, printf('%.1f%%', 100.0::DOUBLE * n / sum(n) OVER ()) AS share, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank FROM c""",
    "provenance_by_entity": """SELECT c_custkey, c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
    "undocumented_tokens": """WITH t AS (SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS token FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders)
      SELECT token, "column" FROM t WHERE token NOT IN (SELECT c_mktsegment FROM customer UNION SELECT r_name FROM region)""",
    "registry_merge": """WITH old AS (SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2)
      SELECT * FROM old UNION ALL SELECT p_brand, p_size, min(p_partkey) FROM part WHERE (p_brand, p_size) NOT IN (SELECT (p_brand, p_size) FROM old) GROUP BY 1, 2""",
    "registry_conflicts": "SELECT c_custkey AS key, c_nationkey AS customer_nation, s_nationkey AS supplier_nation FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey",
    "manifest_diff": """WITH a AS (SELECT p_partkey AS name, sha256('n' || p_partkey % 5) AS d FROM part), b AS (SELECT s_suppkey * 3 AS name, sha256('n' || s_suppkey % 5) AS d FROM supplier)
      SELECT * FROM (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'added' WHEN a.d <> b.d THEN 'moved' END AS status FROM a FULL JOIN b ON a.name = b.name) WHERE status IS NOT NULL""",
    "thickness_ladder": """WITH r AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_size / 16.0::DOUBLE END AS v FROM part), med AS (SELECT p_type, median(v) AS md FROM r WHERE v > 0 GROUP BY 1)
      SELECT p_partkey, CAST(round_even(CASE WHEN v > 0 THEN v ELSE coalesce(md, 0.5) END * 1e6, 0) AS BIGINT) AS thickness_um, CASE WHEN v > 0 THEN 'measured' WHEN md IS NOT NULL THEN 'type_median' ELSE 'default' END AS source
      FROM r LEFT JOIN med USING (p_type)""",
    "next_ap_ids": """WITH top AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), fresh AS (SELECT o_orderkey AS id, unnest(['window', 'niche']) AS kind FROM orders)
      SELECT id, kind, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY id ORDER BY kind) AS BIGINT) AS n FROM fresh LEFT JOIN top ON l_orderkey = id""",
    "calibration_percentiles": """WITH f AS (SELECT p_brand, 'size' AS field, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_brand, 'price', p_retailprice FROM part)
      SELECT p_brand, field, count(*) AS n, CAST(round_even(quantile_cont(v, 0.25) * 1000, 0) AS BIGINT) AS q1, CAST(round_even(quantile_cont(v, 0.5) * 1000, 0) AS BIGINT) AS median, CAST(round_even(quantile_cont(v, 0.75) * 1000, 0) AS BIGINT) AS q3 FROM f GROUP BY 1, 2""",
    "interval_merge": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo FROM events), k AS (SELECT *, CASE WHEN lag(lo) OVER w IS NULL OR lo > lag(lo) OVER w + 600 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY lo)),
      i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM k)
      SELECT user_id, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(lo) + 600 AS hi, count(*) AS n FROM i GROUP BY 1, 2""",
    "ring_gaps": """WITH e AS (SELECT user_id, CAST(CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS DOUBLE) AS lo FROM events),
      k AS (SELECT *, CASE WHEN lag(lo) OVER w IS NULL OR lo > lag(lo) OVER w + 600 + 0.05 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY lo)),
      i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM k), m AS (SELECT user_id, island, min(lo) AS lo, max(lo) + 600 AS hi FROM i GROUP BY 1, 2),
      g AS (SELECT user_id, hi, coalesce(lead(lo) OVER (PARTITION BY user_id ORDER BY lo), min(lo) OVER (PARTITION BY user_id) + 86400) - hi AS width FROM m)
      SELECT user_id, CAST(round_even((hi + width / 2) % 86400 * 1000, 0) AS BIGINT) AS mid_ms, CAST(round_even(width * 1000, 0) AS BIGINT) AS width_ms FROM g WHERE width BETWEEN 300 AND 18000""",
    "first_statement": "SELECT conv_id, role, turn, CAST(length(text) AS INTEGER) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1",
    "dedupe_prefer_placed": """WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS place FROM documents),
      p AS (SELECT min(doc_id) AS doc_id, lang, place FROM d WHERE place IS NOT NULL GROUP BY lang, place)
      SELECT * FROM p UNION ALL SELECT min(doc_id), lang, NULL FROM d WHERE place IS NULL AND lang NOT IN (SELECT lang FROM p) GROUP BY lang""",
    "heading_segments": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
      h AS (SELECT *, last_value(CASE WHEN len(string_split(line, ' ')) <= 5 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading_id FROM l)
      SELECT doc_id, CAST(heading_id AS INTEGER) AS heading_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM h GROUP BY 1, 2""",
    "carry_over": """WITH h AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS answers FROM conversations)
      SELECT conv_id, turn, answers FROM h WHERE role = 'assistant'""",
    "sentence_features": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), '([.;]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2) AS s FROM documents)
      , u AS (SELECT doc_id, unnest(s) AS x FROM s), w AS (SELECT doc_id, x, list_filter(string_split(x, ' '), lambda v: v <> '') AS ws FROM u), k AS (SELECT doc_id, x, len(ws) AS nw, len(list_filter(ws, lambda v: regexp_matches(v, '^[A-Z]'))) AS nc FROM w)
      SELECT d.doc_id, count(x) AS n, CAST(coalesce(max(length(x)), 0) AS BIGINT) AS longest, count(*) FILTER (nw BETWEEN 1 AND 9 AND 2 * nc >= nw) AS n_titles FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""",
    "direction_extract": """SELECT p_partkey, ['N', 'NE', 'SW', NULL, NULL, 'W', NULL, 'S'][p_partkey % 8 + 1] AS code, CAST([0, 45, 225, 270, 315, 270, NULL, 180][p_partkey % 8 + 1] AS BIGINT) AS degrees FROM part""",
    "stated_counts": r"""WITH f AS (SELECT doc_id, regexp_extract(lower(coalesce(text, '')), '(?:^|[ \n])([0-9]+|a|an|one|two|three|four|five|six|seven|eight) (?:[a-z]+ ){0,3}?(?:of|the|hand)', 1) AS w FROM documents)
      SELECT doc_id, CASE WHEN w IN ('a', 'an', 'one') THEN 1 WHEN w = 'two' THEN 2 WHEN w = 'three' THEN 3 WHEN w = 'four' THEN 4 WHEN w = 'five' THEN 5 WHEN w = 'six' THEN 6 WHEN w = 'seven' THEN 7 WHEN w = 'eight' THEN 8 ELSE TRY_CAST(w AS BIGINT) END AS n FROM f WHERE w <> '' AND (NOT regexp_matches(w, '^[0-9]') OR TRY_CAST(w AS BIGINT) IS NOT NULL)""",
    "longest_rising_run": """WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k, length(text) AS n FROM conversations),
      chain AS (SELECT conv_id, k, n, 1 AS len FROM c UNION SELECT c.conv_id, c.k, c.n, chain.len + 1 FROM chain JOIN c ON c.conv_id = chain.conv_id AND c.k > chain.k AND c.n > chain.n)
      SELECT conv_id, CAST(max(len) AS BIGINT) AS lis FROM chain GROUP BY 1""",
    "g_test_classes": """WITH c AS (SELECT count(*) AS n FROM customer WHERE c_nationkey < 9 GROUP BY c_nationkey), t AS (SELECT sum(n) AS n FROM c), g AS (SELECT sum(2 * c.n * ln(c.n / (t.n / 9.0::DOUBLE))) AS g, CAST(any_value(t.n) AS BIGINT) AS n FROM c, t)
      SELECT CAST(round_even(g * 1e6, 0) AS BIGINT) AS g_e6, n, CAST(round_even(exp(-g / 2) * (1 + g / 2 + g * g / 8 + g * g * g / 48) * 1e9, 0) AS BIGINT) AS p_e9 FROM g""",
    "mixture_fit": """WITH c AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS k, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT id, id / 200.0::DOUBLE AS w FROM range(201) r(id)),
      l AS (SELECT id, round(sum(n * ln(w * (k / 15.0::DOUBLE) + (1 - w) * 0.2::DOUBLE)), 6) AS ll FROM c, w GROUP BY id) SELECT CAST(round_even(id / 200.0::DOUBLE * 1000, 0) AS BIGINT) AS w_e3 FROM l ORDER BY ll DESC, id LIMIT 1""",
    "holm_adjust": """WITH p AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, (sum(c_custkey) % 997 + 1) / 20000.0::DOUBLE AS p FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS i, count(*) OVER () AS m FROM p),
      a AS (SELECT name, max(least(1.0::DOUBLE, (m - i) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS h FROM r) SELECT name, CAST(round_even(h * 1e9, 0) AS BIGINT) AS p_holm_e9, h <= 0.05::DOUBLE AS reject FROM a""",
    "permutation_null": f"""WITH h AS (SELECT draw, s_suppkey, s_nationkey, {mixed('draw', 's_suppkey')} AS h FROM supplier, range(40) t(draw)),
      a AS (SELECT draw, s_nationkey AS a, row_number() OVER (PARTITION BY draw ORDER BY s_suppkey) AS k FROM h), b AS (SELECT draw, s_nationkey AS b, row_number() OVER (PARTITION BY draw ORDER BY h, s_suppkey) AS k FROM h)
      SELECT draw, count(*) FILTER (a = b) AS v FROM a JOIN b USING (draw, k) GROUP BY draw""",
    "sequential_stop": """WITH r AS (SELECT o_custkey, row_number() OVER w AS k, sum(CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
      s AS (SELECT o_custkey, min(k) FILTER (cum >= 3) AS stopped_at, max(cum) AS reached, count(*) AS n FROM r GROUP BY 1)
      SELECT o_custkey, stopped_at, CAST(reached AS BIGINT) AS reached, CAST(round_even(CASE WHEN stopped_at IS NOT NULL THEN 3.0::DOUBLE / stopped_at ELSE (reached + 1.0::DOUBLE) / (n + 1.0::DOUBLE) END * 1e9, 0) AS BIGINT) AS p_e9 FROM s""",
    "topk_seen": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 12",
    "stride_sample": f"WITH {DEM_SQL} SELECT r, c, CAST(z AS BIGINT) AS z FROM dem WHERE (r * 64 + c) % 97 = 0",
    "file_digest": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "cumulative_starts": """WITH l AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS len FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, l_linenumber, CAST(len AS BIGINT) AS len, CAST(coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l""",
    "robust_line": """WITH p AS (SELECT CAST(p_partkey % 97 AS DOUBLE) AS x, 3 * (p_partkey % 97) + 7 + (p_partkey % 5 - 2) * 0.25::DOUBLE AS y FROM part WHERE p_partkey % 13 <> 0)
      SELECT CAST(round(regr_slope(y, x) * 1e4) AS BIGINT) AS slope_e4, CAST(round(regr_intercept(y, x) * 1e4) AS BIGINT) AS intercept_e4, count(*) AS n FROM p""",
}
