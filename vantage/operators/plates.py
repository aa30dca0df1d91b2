"""Wall thickness from scanned plans: bands of ink on scan lines, gated by the plan's extent.

Ink is rows (key, r, c) of full cells, plates are rows (key, r0, r1, c0, c1, ppm, traced):
the figure's window with its last row and column left out, cells a metre, and the longer
side of the traced footprint. A scan line is one group, and holds a page's width at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The middle part of a figure that is scanned and in how many steps, fewest readings, walls' range in metres, fewest cells and upper part that tell its extent, how far that may be off.
BAND, STEPS, READINGS, RANGE = (0.3, 0.7), 60, 8, (0.05, 1.5)
CELLS, UPPER, OFF = 100, 0.8, 0.25
LEAST_GAP = 20


def _inside(ink: DataFrame, plates: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ink of each plate's window, with its place (y, x) there and the window's size."""
    rows = ink.select(*key, "r", "c").distinct().join(plates, key).where("r >= r0 AND r < r1 AND c >= c0 AND c < c1")
    return rows.withColumns({"y": F.col("r") - F.col("r0"), "x": F.col("c") - F.col("c0"), "h": F.col("r1") - F.col("r0"), "w": F.col("c1") - F.col("c0")})


def band_readings(ink: DataFrame, plates: DataFrame, key: list[str], room: float = 1.0) -> DataFrame:
    """key, axis, back, line, width: cells from the first ink of a scan line to the last before as much white as a room has; lines without such white give none."""
    rows = _inside(ink, plates, key)
    gap = F.greatest(F.floor(F.col("ppm") * room), F.lit(LEAST_GAP))

    def scanned(axis: str, line: str, at: str, lines: str, length: str) -> DataFrame:
        n = F.col(lines)
        first, step = F.floor(n * BAND[0]), F.greatest(F.floor(n / STEPS), F.lit(1))
        taken = (F.col(line) >= first) & (F.col(line) < F.floor(n * BAND[1])) & ((F.col(line) - first) % step == 0)
        both = rows.where(taken).withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
        place = F.when(F.col("back"), F.col(length) - 1 - F.col(at)).otherwise(F.col(at))
        return both.select(*key, F.lit(axis).alias("axis"), "back", F.col(line).alias("line"), place.alias("at"), F.col(length).alias("length"), gap.alias("gap"))

    each = scanned("row", "y", "x", "h", "w").unionByName(scanned("column", "x", "y", "w", "h"))
    group = [*key, "axis", "back", "line"]
    white = F.coalesce(F.lead("at").over(W.partitionBy(*group).orderBy("at")), F.col("length")) - F.col("at") - 1
    ends = each.withColumn("_last", F.when(white >= F.col("gap"), F.col("at")))
    return ends.groupBy(*group).agg((F.min("_last") - F.min("at") + 1).alias("width")).where("width IS NOT NULL")


def extent_ratio(ink: DataFrame, plates: DataFrame, key: list[str]) -> DataFrame:
    """key, ratio: the drawn span of a figure's upper part over the traced one; null where there is too little ink or nothing traced."""
    s = _inside(ink, plates, key).withColumn("_in", F.col("y") < F.col("h") * UPPER)
    span = lambda k: F.max(F.when(F.col("_in"), F.col(k))) - F.min(F.when(F.col("_in"), F.col(k)))
    sums = s.groupBy(*key, "ppm", "traced").agg(F.count_if("_in").alias("_n"), F.greatest(span("x"), span("y")).alias("_d"))
    return sums.select(*key, F.when((F.col("_n") >= CELLS) & (F.col("traced") > 0), F.col("_d") / F.col("ppm") / F.col("traced")).alias("ratio"))


def plate_thickness(ink: DataFrame, plates: DataFrame, key: list[str], room: float = 1.0) -> DataFrame:
    """key, thickness and iqr in metres, n readings, ratio for every plate (unique by key): thickness, n and iqr are null where too few lines give a reading or where the extent is off or unknown."""
    read = band_readings(ink, plates, key, room).join(plates.select(*key, "ppm"), key).withColumn("_v", F.col("width") / F.col("ppm"))
    fine = F.when((F.col("_v") > RANGE[0]) & (F.col("_v") < RANGE[1]), F.col("_v"))
    sums = read.groupBy(*key).agg(F.count(fine).alias("_n"), F.median(fine).alias("_m"), (F.percentile(fine, 0.75) - F.percentile(fine, 0.25)).alias("_i"))
    out = plates.select(*key).join(sums, key, "left").join(extent_ratio(ink, plates, key), key, "left")
    ok = (F.col("_n") >= READINGS) & (F.abs(F.col("ratio") - 1) <= OFF)
    return out.select(*key, *(F.when(ok, F.col(c)).alias(n) for c, n in (("_m", "thickness"), ("_n", "n"), ("_i", "iqr"))), "ratio")
