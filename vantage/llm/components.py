"""Connected components of links, by hooking and pointer jumping.

Every round lets each component point to the smallest one it has a link to, if that is
smaller than itself; pointers then jump to their roots, links are renamed to roots, and
those inside a component go. All of it is joins and sums made before the shuffle; only
counts reach the driver. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep


def roots(parents: DataFrame) -> DataFrame:
    """node, parent (smaller than node) -> node, root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = keep(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jump")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("root"))


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, comp (the smallest node of its component) of every node of the links (a, b), or of labels (node, comp) as far as it is known."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    if labels is None:
        labels = ends.distinct().select("node", F.col("node").alias("comp"))
    else:
        fresh = ends.distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
        labels = keep(labels.select("node", "comp").union(fresh), "labels")
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        across = links.join(a, "a").join(b, "b").where("ca <> cb")
        hooks = keep(across.select(F.greatest("ca", "cb").alias("node"), F.least("ca", "cb").alias("to")).groupBy("node").agg(F.min("to").alias("parent")), "hooks")
        if hooks.isEmpty():
            return labels
        top = roots(hooks).select(F.col("node").alias("comp"), "root")
        labels = keep(labels.join(top, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")
