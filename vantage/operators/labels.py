"""Labels of connected cells, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept

def label_cells(cells: DataFrame, width: int) -> DataFrame:
    """cells (r, c) with label, the smallest r * width + c of their four-connected blob.

    Each round, a label takes the smallest label beside its cells, and labels then follow one another to the end.
    """
    at = (F.col("r") * width + F.col("c")).cast("long")
    labelled = kept(cells.select("r", "c", at.alias("label")).distinct())
    steps = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    while True:
        spread = labelled.withColumn("s", F.explode(steps)).select((F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), F.col("label").alias("beside"))
        hooks = kept(labelled.join(spread, ["r", "c"]).where("beside < label").groupBy("label").agg(F.min("beside").alias("to")))
        if hooks.isEmpty():
            return labelled
        while True:
            ahead = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            hooks = kept(hooks.join(ahead, "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        labelled = kept(labelled.join(hooks.select("label", "to"), "label", "left").select("r", "c", F.coalesce("to", "label").alias("label")))
