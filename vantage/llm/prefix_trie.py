"""Prefix trie of conversations, by truncation peeling.

Each distinct sequence of first turns is a node. Conversations are peeled from the
greatest depth down: at each depth those that end there are merged with the nodes that
survive from below, equal ones become one node, whose members, children, leaves and
savings are summed as it is found; then each node loses its last turn and they are
grouped again. A node is known by a 128-bit hash of its turns.

Where the work runs: equal conversations are one row before anything else. A branch of at
most `most` rows (turns of distinct conversations) is peeled whole in one task, many
branches at once; what is left above are the few nodes with more below them. Their
branches' sums are added before the shuffle, and the nodes are peeled in one task as soon
as there are at most `crown` of them, and before that a depth at a time by a grouping of
all. So no node's members, however many, meet in one task but for their ids: the digest of
the conversations that end at a node is a hash over all of them in order, so it streams
over sorted ids and keeps none.

Texts are hashed where they are read and never shuffled. Turns are numbered over parts of
a sort by range, and hashes run on over stretches of CHUNK turns, so a conversation of any
length is no single task's work either.

Cases: turns are ordered by turn, null first; of equal turns by role, then by a hash of
the text, and repeated rows are turns of their own; null role and text count as empty;
rows without a conv_id belong to no conversation; a very long text is a turn like others;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import crc32_sql, keep, small_batches

CHUNK = 1024
MOST, CROWN = 1 << 17, 1 << 21
#: Rows that a task peels at once, a last branch apart.
AT_ONCE = 1 << 16
FAMILY, SHARED = 100, 6
NODE = "a long, b long, depth long, up_a long, up_b long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), h1 and h2 (hashes of role and text) and size (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.length(text).cast("long").alias("size"))
    order = [F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    dealt = keep(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # of each part only the conversation that began in an earlier one: no more rows than parts
    skips = counts.select("conv_id", "part", before.alias("skip")).where("skip > 0")
    at = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
    placed = dealt.withColumn("at", at).join(F.broadcast(skips), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("skip", F.lit(0))).cast("long").alias("pos"), "h1", "h2", "size")


def with_family_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first turns taken from its family's first conversation: (conv_id, depth, h1, h2, size), and (conv_id, length)."""
    taken = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(SHARED))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = sizes.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = sizes.select("conv_id", "n", base.alias("base"), taken("conv_id").alias("h")).join(heads, "base", "left")
    convs = keep(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("own"), "n"), "families")
    first = turns.where(f"conv_id % {FAMILY} = 0 AND pos < {SHARED}").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "h1", "h2", "size")
    begun = convs.where("own > 0").join(first, "base").where("depth <= h").select("conv_id", "depth", "h1", "h2", "size")
    rest = turns.where(F.col("pos") > taken("conv_id")).join(convs.select("conv_id", "h", "own"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("own")).alias("depth"), "h1", "h2", "size")
    return begun.unionByName(rest), convs.select("conv_id", (F.col("own") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, size, a and b (of the turns up to this one), up_a and up_b (of those before it)."""
    own = turns.select("conv_id", "depth", "size", F.xxhash64("depth", "h1").alias("x"), F.xxhash64("h2", "depth").alias("y"), F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"))
    earlier = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = own.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    begun = whole.select("conv_id", "chunk", F.bit_xor("x").over(earlier).alias("x0"), F.bit_xor("y").over(earlier).alias("y0")).where("chunk > 0")
    upto = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = own.withColumns({"a": F.bit_xor("x").over(upto), "b": F.bit_xor("y").over(upto)}).join(begun, ["conv_id", "chunk"], "left")
    a, b = (F.col(k).bitwiseXOR(F.coalesce(s, F.lit(0))) for k, s in (("a", "x0"), ("b", "y0")))
    return run.select("conv_id", "depth", "size", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"))


def ended(last: DataFrame) -> DataFrame:
    """Of (conv_id, depth, a, b), the last node of each conversation: a row a node, with its smallest conversation, their number and the hash of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, digest = None, 0, 0, None
        for batch in batches:
            a, b, depth, ids = (batch.column(k).to_numpy() for k in ("a", "b", "depth", "conv_id"))
            begins = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1]))))
            done = []
            for low, high in zip(begins, [*begins[1:], len(ids)]):
                this = (int(a[low]), int(b[low]), int(depth[low]))
                listed = ",".join(map(str, ids[low:high].tolist()))
                if this == key:
                    digest.update(f",{listed}".encode())
                    n += int(high - low)
                    continue
                if key is not None:
                    done.append((*key, first, n, digest.hexdigest()))
                key, first, n, digest = this, int(ids[low]), int(high - low), hashlib.sha256(listed.encode())
            if done:
                yield rows(done)
        if key is not None:
            yield rows([(*key, first, n, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["a", "b", "depth", "conv_id", "n", "ends_sha256"])

    dealt = last.select("a", "b", "depth", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "depth", "conv_id")
    return dealt.mapInArrow(run, "a long, b long, depth long, conv_id long, n long, ends_sha256 string")


def peel(a, b, depth, size, above, n, first, kids, leaves, saved) -> dict[str, np.ndarray]:
    """Nodes of branches, deepest first. above: the row that a row becomes when its last turn goes, -1 where its branch ends; rows with n > 0 begin, at their depth, with such sums."""
    begun = np.flatnonzero(n)
    begun = begun[np.argsort(depth[begun], kind="stable")]
    starts = {int(d): begun[i:j] for d, i, j in zip(*bounds(depth[begun]))}
    alive = {"row": begun[:0], "n": n[:0], "first": first[:0], "leaves": leaves[:0], "saved": saved[:0], "child": begun[:0]}
    out, parent, count = [], [], 0
    for d in range(int(depth.max(initial=0)), int(depth.min(initial=0)) - 1, -1):
        new = starts.get(d, begun[:0])
        row = np.concatenate((above[alive["row"]], new))
        if not len(row):
            continue
        had = np.concatenate((np.ones(len(alive["row"]), np.int64), kids[new]))
        cols = [np.concatenate((alive[k], x[new])) for k, x in (("n", n), ("first", first), ("leaves", leaves), ("saved", saved))]
        order = np.lexsort((b[row], a[row]))
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(a[row][order]) != 0) | (np.diff(b[row][order]) != 0))))
        add = lambda x: np.add.reduceat(x[order], begin)
        children, total, least = add(had), add(cols[0]), np.minimum.reduceat(cols[1][order], begin)
        which = np.empty(len(row), np.int64)
        which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(row))))
        head = row[order][begin]
        ends = np.full(len(begin), -1)
        ends[which[len(alive["row"]) :]] = new
        found = {"row": head, "n": total, "first": least, "kids": children, "leaves": np.where(children > 0, add(cols[2]), 1), "saved": add(cols[3]) + (total - 1) * size[head], "ends": ends}
        out.append(found)
        parent.append((alive["child"], least[which[: len(alive["row"])]]))
        going = above[head] >= 0
        alive = {k: found[k][going] for k in ("row", "n", "first", "leaves", "saved")} | {"child": (count + np.arange(len(begin)))[going]}
        count += len(begin)
    whole = {k: np.concatenate([x[k] for x in out]) if out else begun[:0] for k in ("row", "n", "first", "kids", "leaves", "saved", "ends")}
    whole["parent"] = np.full(count, -1, np.int64)
    whole["top"] = np.ones(count, bool)
    for child, own in parent:
        whole["parent"][child], whole["top"][child] = own, False
    return whole


def bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, and where each begins and ends."""
    begin = np.flatnonzero(np.concatenate(([True], np.diff(sorted_values) != 0))) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[begin], begin, np.append(begin[1:], len(sorted_values))


def as_nodes(t: dict[str, np.ndarray], sha: pa.Array, got: dict[str, np.ndarray]) -> pa.RecordBatch:
    row = got["row"]
    ends = sha.take(pa.array(got["ends"], mask=got["ends"] < 0))
    cols = [t["a"][row], t["b"][row], t["depth"][row], t["up_a"][row], t["up_b"][row], got["first"]]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, cols), pa.array(got["parent"], mask=got["top"]), *(pa.array(got[k]) for k in ("n", "kids", "leaves", "saved")), ends.fill_null(_NO_ENDS), pa.array(got["top"])],
        [c.split()[0] for c in NODE.split(", ")],
    )


def peel_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, depth, up_a, up_b, size, conv_id, n, ends_sha256, top_a, top_b) sorted by branch, conversation and depth; n is 0 but at a conversation's end."""
    names = ("a", "b", "depth", "up_a", "up_b", "size", "conv_id", "n", "top_a", "top_b")

    def run(table: pa.Table) -> pa.RecordBatch:
        t = {k: table.column(k).to_numpy() for k in names}
        at = np.arange(len(t["a"]))
        goes_on = np.zeros(len(at), bool)
        goes_on[1:] = (np.diff(t["conv_id"]) == 0) & (np.diff(t["top_a"]) == 0) & (np.diff(t["top_b"]) == 0)
        none = np.zeros(len(at), np.int64)
        got = peel(t["a"], t["b"], t["depth"], t["size"], np.where(goes_on, at - 1, -1), t["n"], t["conv_id"], none, none, none)
        return as_nodes(t, table.column("ends_sha256").combine_chunks(), got)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        x, y = table.column("top_a").to_numpy(), table.column("top_b").to_numpy()
        last = int(np.searchsorted(-((x != x[-1]) | (y != y[-1])).astype(np.int8), 0))
        if last:
            yield run(table.slice(0, last).combine_chunks())
            held = table.slice(last).combine_chunks().to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield run(table)


def peel_crown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes above all branches, each once, with the sums that its branches and its own conversations bring."""
    held = list(batches)
    if not held or not (table := pa.Table.from_batches(held)).num_rows:
        return
    names = ("a", "b", "depth", "up_a", "up_b", "size", "n", "first", "kids", "leaves", "saved")
    t = {k: table.column(k).to_numpy() for k in names}
    at = {key: k for k, key in enumerate(zip(t["a"].tolist(), t["b"].tolist(), t["depth"].tolist()))}
    above = np.array([at.get((x, y, d - 1), -1) for x, y, d in zip(t["up_a"].tolist(), t["up_b"].tolist(), t["depth"].tolist())], np.int64)
    got = peel(t["a"], t["b"], t["depth"], t["size"], above, t["n"], t["first"], t["kids"], t["leaves"], t["saved"])
    yield as_nodes(t, table.column("ends_sha256").combine_chunks(), got)


SUMS = {"n": F.sum, "first": F.min, "kids": F.sum, "leaves": F.sum, "saved": F.sum, "ends_sha256": F.max}


def prefix_trie(turns: DataFrame, convs: DataFrame, most: int = MOST, crown: int = CROWN) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id (its parent's), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ...), h1, h2, size; convs: conv_id, length, one row a
    conversation, those without a turn too. A node's last turn is that of conv_id at depth.
    """
    key = ["a", "b", "depth"]
    up = lambda rows: rows.select(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth"), F.col("n_convs").alias("n"), F.col("conv_id").alias("first"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends_sha256"))
    marks = keep(prefix_hashes(turns), "prefixes")
    last = marks.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("k"), F.max("depth").alias("depth")).select("conv_id", "k.a", "k.b", "depth")
    silent = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"))
    ends = keep(ended(last.unionByName(silent)), "ends")
    one_each = ends.select("conv_id", F.col("depth").alias("length"), "n", "ends_sha256")
    own_end = F.col("depth") == F.col("length")
    paths = keep(marks.join(one_each, "conv_id").select("conv_id", *key, "up_a", "up_b", "size", "length", F.when(own_end, F.col("n")).otherwise(0).alias("n"), F.when(own_end, F.col("ends_sha256")).alias("ends_sha256")), "paths")
    # nodes with more than `most` rows below them, and the root
    below = paths.groupBy(*key).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("w"), *(F.max(c).alias(c) for c in ("up_a", "up_b", "size"))).where(F.col("w") > most).drop("w")
    root = marks.sparkSession.createDataFrame([(0, 0, 0, 0, 0, 0)], "a long, b long, depth long, up_a long, up_b long, size long")
    high = keep(below.unionByName(root), "crown")
    low = paths.join(high.select(*key), key, "left_anti")
    tops = low.groupBy("conv_id").agg(F.min_by(F.struct("a", "b"), "depth").alias("t")).select("conv_id", F.col("t.a").alias("top_a"), F.col("t.b").alias("top_b"))
    dealt = low.join(tops, "conv_id").repartition("top_a", "top_b").sortWithinPartitions("top_a", "top_b", "conv_id", "depth")
    cold = keep(dealt.select("a", "b", "depth", "up_a", "up_b", "size", "conv_id", "n", "ends_sha256", "top_a", "top_b").mapInArrow(peel_branches, NODE), "branches")
    here = ends.join(high.select(*key), key, "left_semi").select(*key, "n", F.col("conv_id").alias("first"), *(F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")), "ends_sha256")
    sums = keep(up(cold.where("top")).unionByName(here).groupBy(*key).agg(*(f(c).alias(c) for c, f in SUMS.items())), "sums")
    levels = []
    while (left := high.agg(F.count("*").alias("n"), F.max("depth").alias("d")).first())["n"] > crown and left["d"] > 0:
        at, above = high.where(F.col("depth") == left["d"]), F.col("depth") < left["d"]
        saved = F.col("saved") + (F.col("n") - 1) * F.col("size")
        level = at.join(sums, key).select(*key, "up_a", "up_b", F.col("first").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"), F.lit(True).alias("top"))
        levels.append(keep(level, "level"))
        sums = keep(up(levels[-1]).unionByName(sums.where(above)).groupBy(*key).agg(*(f(c).alias(c) for c, f in SUMS.items())), "sums")
        high = high.where(above)
    left = high.join(sums, key, "left").select(*key, "up_a", "up_b", "size", *(F.coalesce(c, F.lit(0)).alias(c) if c != "ends_sha256" else F.col(c) for c in SUMS))
    upper = keep(left.repartition(1).mapInArrow(peel_crown, NODE), "upper")
    for level in levels:
        upper = upper.unionByName(level)
    nodes = cold.where("NOT top").drop("top").unionByName(with_parents(cold.where("top"), upper)).unionByName(with_parents(upper, upper))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def with_parents(rows: DataFrame, upper: DataFrame) -> DataFrame:
    """rows with the conv_id of the node above each, one of upper; null for the root."""
    over = upper.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    return rows.join(over, ["up_a", "up_b", "depth"], "left").select("a", "b", "depth", "up_a", "up_b", "conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each begun with the first turns of its hundred's first one."""
    small_batches(spark)
    turns = keep(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "numbered")
    return prefix_trie(*with_family_starts(turns))


OP11_SQL = f"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), plan AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("conv_id")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM numbered)
), rebuilt AS (
  SELECT p.conv_id, 0 AS own, n.pos, n.role, n.text FROM plan p JOIN numbered n ON n.conv_id = p.base AND n.pos <= p.h
  UNION ALL
  SELECT p.conv_id, 1 AS own, n.pos, n.role, n.text FROM plan p JOIN numbered n ON n.conv_id = p.conv_id AND n.pos > p.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, length(text) AS size, sha256(length(role) || ':' || role || text) AS h FROM rebuilt
), marks AS (
  SELECT conv_id, depth, size, sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan
), lengths AS (
  SELECT conv_id, max(depth) AS d FROM marks GROUP BY conv_id
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM marks GROUP BY depth, node
), owned AS (
  SELECT n.*, p.node AS up, q.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN marks p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.depth = p.depth AND q.node = p.node
), kids AS (
  SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM owned WHERE up IS NOT NULL GROUP BY ALL
), sums AS (
  SELECT m.depth, m.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((o.n_convs - 1) * o.size) AS saved_tokens
  FROM owned o LEFT JOIN kids k ON k.depth = o.depth AND k.node = o.node JOIN marks m ON m.conv_id = o.conv_id AND m.depth <= o.depth GROUP BY ALL
), ends AS (
  SELECT m.depth, m.node, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS ends_sha256 FROM marks m JOIN lengths l ON l.conv_id = m.conv_id AND l.d = m.depth GROUP BY ALL
)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, o.parent_conv_id, o.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM owned o JOIN sums s ON s.depth = o.depth AND s.node = o.node LEFT JOIN kids k ON k.depth = o.depth AND k.node = o.node LEFT JOIN ends e ON e.depth = o.depth AND e.node = o.node
"""
