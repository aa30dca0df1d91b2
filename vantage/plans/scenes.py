"""Scenes derived from the driver tables, and the same derivations as DuckDB SQL.

The grid is 64 x 64 with whole heights 1 to 8 (0: no data); every supplier is an
observer standing on it, at a place by a hash of its key; parts are footprints and
openings. The wide scene's grid grows with the tables: it has about 16 cells for each
order, and every customer has a ray somewhere over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators.grid import Grid, nearest
from vantage.operators.scratch import kept
from vantage.operators.stats import mix_hash
from vantage.session import table

GRID = Grid()
RADIUS = 8.0


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, z (null: no data) for all cells that lineitem fills, written down: a scene's eyes, surface and targets all come from it."""
    z = F.sum(F.col("l_quantity").cast("bigint") * 7 + F.col("l_suppkey")) % 9
    filled = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 64).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c")).agg(z.alias("z"))
    return kept(filled.select("r", "c", F.when(F.col("z") > 0, F.col("z").cast("double")).alias("z")))


def eyes(spark: SparkSession, sf_dir: str, heights: DataFrame, up: float = 1.6) -> DataFrame:
    """eye, ex, ey, ez of all suppliers that stand on a cell with data."""
    at = lambda seed: mix_hash(F.lit(seed), F.col("s_suppkey")) % 62 + 1.5
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("eye"), at(41).cast("double").alias("ex"), (-at(43)).cast("double").alias("ey"))
    return nearest(s, heights, GRID, "ex", "ey", "g").where("g IS NOT NULL").select("eye", "ex", "ey", (F.col("g") + up).alias("ez"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, x1, y1, height: a footprint for each part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k * 11 % 60).cast("double"), (-(k * 17 % 60) - 4).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 1 + s % 4).alias("x1"), (y0 + 1 + s % 3).alias("y1"), (s % 7 + 1).cast("double").alias("height"))


def mixed(*parts: str) -> str:
    """mix_hash() of whole numbers in SQL."""
    out = "17::BIGINT"
    for p in parts:
        out = f"(({out}) * 48271 + CAST({p} AS BIGINT) % 2147483647 + 11) % 2147483647"
    out = f"(({out}) * ({out}) + 7) % 2147483647 * 16807 % 2147483647"
    return f"((({out}) * ({out}) + 7) % 2147483647)"


DEM_SQL = f"""
dem AS (
  SELECT r, c, CASE WHEN z > 0 THEN CAST(z AS DOUBLE) END AS z FROM (
    SELECT CAST(l_orderkey % 64 AS INTEGER) AS r, CAST(l_partkey % 64 AS INTEGER) AS c, sum(CAST(l_quantity AS BIGINT) * 7 + l_suppkey) % 9 AS z
    FROM lineitem GROUP BY 1, 2)
), four AS (
  SELECT a.r, a.c, a.z AS z00, b.z AS z01, d.z AS z10, e.z AS z11 FROM dem a
  JOIN dem b ON b.r = a.r AND b.c = a.c + 1 JOIN dem d ON d.r = a.r + 1 AND d.c = a.c JOIN dem e ON e.r = a.r + 1 AND e.c = a.c + 1
  WHERE a.z IS NOT NULL AND b.z IS NOT NULL AND d.z IS NOT NULL AND e.z IS NOT NULL
), spots AS (
  SELECT s_suppkey AS eye, CAST({mixed('41', 's_suppkey')} % 62 + 1 AS INTEGER) AS pc, CAST({mixed('43', 's_suppkey')} % 62 + 1 AS INTEGER) AS pr FROM supplier
), eyes AS (
  SELECT eye, pc + 0.5::DOUBLE AS ex, -(pr + 0.5::DOUBLE) AS ey, z + 1.6::DOUBLE AS ez FROM spots JOIN dem ON r = pr AND c = pc WHERE z IS NOT NULL
), rects AS (
  SELECT p_partkey AS id, CAST(p_partkey * 11 % 60 AS DOUBLE) AS x0, CAST(-(p_partkey * 17 % 60) - 4 AS DOUBLE) AS y0,
    CAST(p_partkey * 11 % 60 + 1 + p_size % 4 AS DOUBLE) AS x1, CAST(-(p_partkey * 17 % 60) - 4 + 1 + p_size % 3 AS DOUBLE) AS y1, CAST(p_size % 7 + 1 AS DOUBLE) AS height
  FROM part
)"""


def los_sql(rays: str, keys: str, tag: str = "") -> str:
    """CTEs measured, samples, horizons and seen (with a tag) over a CTE of rays (keys, ex, ey, ez, tx, ty, tz)."""
    return f"""
measured{tag} AS (
  SELECT *, sqrt((tx - ex) * (tx - ex) + (ty - ey) * (ty - ey)) AS dist FROM {rays}
), samples{tag} AS (
  SELECT {keys}, ez, CAST(k AS DOUBLE) AS d, -(ey + (ty - ey) / dist * k) - 0.5::DOUBLE AS rf, ex + (tx - ex) / dist * k - 0.5::DOUBLE AS cf
  FROM (SELECT *, unnest(range(1, CAST(floor(dist - 1) AS BIGINT) + 1)) AS k FROM measured{tag} WHERE dist >= 2)
), horizons{tag} AS (
  SELECT {keys}, max((((z00 * (1 - (cf - fc)) + z01 * (cf - fc)) * (1 - (rf - fr)) + (z10 * (1 - (cf - fc)) + z11 * (cf - fc)) * (rf - fr)) - ez) / d) AS horizon
  FROM samples{tag} JOIN (SELECT r AS fr, c AS fc, z00, z01, z10, z11 FROM four) ON fr = CAST(floor(rf) AS INTEGER) AND fc = CAST(floor(cf) AS INTEGER) GROUP BY {keys}
), seen{tag} AS (
  SELECT m.*, (dist > 0 AND tz IS NOT NULL AND (dist < 1 OR horizon IS NULL OR (tz - ez) / nullif(dist, 0) >= horizon - 1e-6)) AS visible
  FROM measured{tag} m LEFT JOIN horizons{tag} h USING ({keys})
)"""


CELL_RAYS_SQL = f"""
rays AS (
  SELECT eye, r, c, ex, ey, ez, c + 0.5::DOUBLE AS tx, -(r + 0.5::DOUBLE) AS ty, z AS tz FROM eyes JOIN dem
  ON (c + 0.5::DOUBLE - ex) * (c + 0.5::DOUBLE - ex) + (-(r + 0.5::DOUBLE) - ey) * (-(r + 0.5::DOUBLE) - ey) <= {RADIUS * RADIUS}
)"""


def wide_grid(spark: SparkSession, sf_dir: str) -> Grid:
    side = 8 * int(table(spark, sf_dir, "orders").count() ** 0.5 / 2)
    return Grid(h=side, w=side)


def wide_dem(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """r, c, z: rolling heights 0 to 28 with holes, from a profile of the orders along rows and one of the customers along columns."""
    n = grid.w
    a = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % n).cast("int").alias("r")).agg((F.sum("o_custkey") % 23).alias("a"))
    b = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") * 7 % n).cast("int").alias("c")).agg((F.sum(F.col("c_custkey") + F.col("c_nationkey")) % 19).alias("b"))
    cells = spark.range(n).select(F.col("id").cast("int").alias("r")).join(a, "r", "left").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(b, "c", "left")
    z = (F.coalesce("a", F.lit(5)) * F.coalesce("b", F.lit(3)) + F.col("r") * 3 + F.col("c")) % 29
    return cells.select("r", "c", F.when((F.col("r") * 31 + F.col("c") * 17) % 97 > 0, z.cast("double")).alias("z"))


def wide_rays(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """A ray for each customer, from a place by hash to one within a third of the grid."""
    k, n = F.col("c_custkey"), grid.w
    h = lambda seed, m: mix_hash(F.lit(seed), k) % m
    inside = lambda p: F.greatest(F.lit(1), F.least(F.lit(n - 2), p)) + 0.5
    third = n // 3
    far = lambda seed, p: inside(p + h(seed, 2 * third + 1) - third)
    return table(spark, sf_dir, "customer").select(k.alias("ray"), inside(h(51, n)).cast("double").alias("ex"), (-inside(h(52, n))).cast("double").alias("ey"), (h(53, 40) + 20).cast("double").alias("ez"), far(54, h(51, n)).cast("double").alias("tx"), (-far(55, h(52, n))).cast("double").alias("ty"), (h(56, 50) + 10).cast("double").alias("tz"))


def _inside_sql(p: str) -> str:
    return f"greatest(1, least(n - 2, {p})) + 0.5::DOUBLE"


WIDE_SQL = f"""
side AS (
  SELECT CAST(8 * floor(sqrt(count(*)) / 2) AS BIGINT) AS n FROM orders
), up AS (
  SELECT o_orderkey % n AS r, sum(o_custkey) % 23 AS a FROM orders, side GROUP BY 1
), over AS (
  SELECT c_custkey * 7 % n AS c, sum(c_custkey + c_nationkey) % 19 AS b FROM customer, side GROUP BY 1
), wide_dem AS (
  SELECT CAST(y AS INTEGER) AS r, CAST(x AS INTEGER) AS c, CASE WHEN (y * 31 + x * 17) % 97 > 0 THEN CAST((coalesce(a, 5) * coalesce(b, 3) + y * 3 + x) % 29 AS DOUBLE) END AS z
  FROM (SELECT unnest(range(n)) AS y FROM side), (SELECT unnest(range(n)) AS x FROM side) LEFT JOIN up ON r = y LEFT JOIN over ON c = x
), four AS (
  SELECT r, c, z AS z00, lead(z) OVER across AS z01, lead(z) OVER down AS z10, lead(z, 1) OVER slant AS z11 FROM wide_dem
  WINDOW across AS (PARTITION BY r ORDER BY c), down AS (PARTITION BY c ORDER BY r), slant AS (PARTITION BY c - r ORDER BY r)
  QUALIFY z00 IS NOT NULL AND z01 IS NOT NULL AND z10 IS NOT NULL AND z11 IS NOT NULL
), thrown AS (
  SELECT c_custkey AS ray, n, n // 3 AS third, {mixed('51', 'c_custkey')} % n AS px, {mixed('52', 'c_custkey')} % n AS py, c_custkey AS k FROM customer, side
), wide AS (
  SELECT ray, {_inside_sql('px')} AS ex, -({_inside_sql('py')}) AS ey, CAST({mixed('53', 'k')} % 40 + 20 AS DOUBLE) AS ez,
    {_inside_sql(f"px + {mixed('54', 'k')} % (2 * third + 1) - third")} AS tx, -({_inside_sql(f"py + {mixed('55', 'k')} % (2 * third + 1) - third")}) AS ty, CAST({mixed('56', 'k')} % 50 + 10 AS DOUBLE) AS tz FROM thrown
)"""
