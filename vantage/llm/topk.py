"""Exact top-k by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it, which falls in one
of RINGS annuli of about equally many rows. The largest inner product is a smallest
distance once each vector gets one more component, sqrt(M^2 - |x|^2), with M the largest
norm; a query gets 0 there. Pivots are chosen farthest first from a sample of at most
SAMPLE rows; every row is indexed.

Of each annulus the least and largest distance to every pivot are known. By the triangle
inequality its vectors are no nearer to a query than the largest gap between such a range
and the query's own distance to that pivot. A search sorts the annuli by that bound, for
each query, and expands them in passes of growing length (PASSES); after a pass a query
stops at the first annulus that can't hold its k-th score any more. A query is only held
against the annuli that it asks for itself.

Vectors of an annulus are stored in blocks of at most BLOCK_ROWS, queries in blocks of
QUERY_ROWS; a unit of work is one of each, so no annulus, however many copies of one
vector it holds, is a single task's work. Only pivots and the annuli's bounds, at most
PIVOTS x RINGS x PIVOTS numbers, are held by the driver.

Cases: vectors that are null, or hold a null or non-finite component, take no part;
shorter vectors, empty ones too, count as filled up with zeros; a component or a score
beyond 64 bits is an error that says so; ties go to the smaller vec_id; each of several
rows with one vec_id is a candidate and, where asked for, a query of its own that
excludes only itself; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import keep, small_batches

PIVOTS, RINGS = 48, 16
SAMPLE = 2048
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Annuli that a query has expanded to after each pass; the last takes all that the bounds leave.
PASSES = (4, 64, PIVOTS * RINGS)
#: Rows that an annulus should hold at least: few vectors get fewer pivots and annuli.
CELL_ROWS = 16
SCALE = 64
HIT = "query_rid long, query_id long, vec_id long, score long"


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """rid, vec_id, v: floor(scale * component) of the vectors that take part, with a number for each row, written down with it."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fine = table.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")).where("x IS NOT NULL").where(F.forall("x", finite))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component passes 64 bits")).cast("long"))
    return keep(fine.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.transform("x", whole).alias("v")), "vectors")


def matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for k, row in enumerate(column):
        row = np.asarray(row.values if hasattr(row, "values") else row, np.int64)
        out[k, : len(row)] = row
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes all norms alike."""
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """At most so many of the points, each the farthest from those before it."""
    chosen, near = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(most, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def products(q: np.ndarray, m: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Exact inner products, in the cheapest numbers that hold them; those to skip may pass 64 bits."""
    size = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    most = size(q) * size(m) * q.shape[1]
    if most < 2**63:
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        return (q.astype(kind) @ m.astype(kind).T).astype(np.int64)
    exact = q.astype(object) @ m.astype(object).T
    exact[skip] = 0
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 2**63:
        raise OverflowError("a score passes 64 bits")
    return exact.astype(np.int64)


def reach(gap: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """The largest inner product that so large a distance allows, with room for rounding."""
    best = ((q * q).sum(1)[:, None] + top - gap * gap) / 2
    return best + np.abs(best) * 1e-9 + 4e-6 * (1 + top)


def gaps(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Queries x annuli: the least distance by all pivots. d: queries x pivots; low, high: annuli x pivots."""
    out = np.zeros((len(d), len(low)))
    for p in range(d.shape[1]):
        np.maximum(out, d[:, p, None] - high[None, :, p], out=out)
        np.maximum(out, low[None, :, p] - d[:, p, None], out=out)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: rid, vec_id, v; queries: some of its rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top"), F.max(most).alias("most")).first()
    if not stats["n"]:
        return empty
    dim, top, most = max(1, stats["dim"]), stats["top"], stats["most"] or 0.0
    store = np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    sample = vectors.select("rid", "v").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).toPandas()
    pivots = farthest_first(lifted(matrix(sample["v"], dim), top), min(PIVOTS, max(8, math.isqrt(stats["n"]) // 2)))
    n_rings = min(RINGS, max(1, stats["n"] // (len(pivots) * CELL_ROWS)))
    packed = lambda x: pa.array([r.tobytes() for r in x.astype(store)], pa.binary())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            d = distances(lifted(x, top), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), packed(x), pa.array(near), pa.array(d[np.arange(len(d)), near])], ["rid", "vec_id", "v", "near", "dist"])

    keys = keep(vectors.select("rid", "vec_id", "v").mapInArrow(keyed, "rid long, vec_id long, v binary, near long, dist double"), "pivot-keys")
    cell = F.col("near") * RINGS
    if n_rings > 1:
        steps = F.array(*(F.lit(i / n_rings) for i in range(1, n_rings)))
        rings = {r["near"]: r["cuts"] for r in keys.groupBy("near").agg(F.percentile_approx("dist", steps, F.lit(1000)).alias("cuts")).collect()}
        cuts = F.create_map(*(x for p, c in sorted(rings.items()) for x in (F.lit(p), F.array(*map(F.lit, c)))))
        cell = cell + F.size(F.filter(cuts[F.col("near")], lambda c: c < F.col("dist")))
    index = keys.withColumn("cell", cell)
    counts = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cell_of = np.array(sorted(counts), np.int64)
    salts = F.create_map(*(x for c in sorted(counts) for x in (F.lit(int(c)), F.lit(math.ceil(counts[c] / BLOCK_ROWS)))))

    def blocked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "rid"])
        m = b"".join(pdf["v"])
        d = distances(lifted(np.frombuffer(m, store).reshape(-1, dim), top), pivots)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "rids": [pdf["rid"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "m": [m], "low": [d.min(0).tolist()], "high": [d.max(0).tolist()]})

    with_salt = index.withColumn("salt", F.pmod(F.xxhash64("rid"), salts[F.col("cell")])).drop("near", "dist")
    blocks = keep(with_salt.groupBy("cell", "salt").applyInPandas(blocked, "cell long, rids binary, ids binary, m binary, low array<double>, high array<double>"), "vector-blocks")
    ranges = blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("p", "d")).groupBy("cell", "p").agg(F.min("d.low").alias("low"), F.max("d.high").alias("high")).toPandas()
    low, high = np.zeros((len(cell_of), len(pivots))), np.zeros((len(cell_of), len(pivots)))
    at = np.searchsorted(cell_of, ranges["cell"])
    low[at, ranges["p"]], high[at, ranges["p"]] = ranges["low"], ranges["high"]
    blocks = blocks.drop("low", "high")

    # a query lies at another place than its own row: its added component is 0
    def near_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            home = distances(np.column_stack((x, np.zeros(len(x)))), pivots).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), packed(x), pa.array(home)], ["rid", "vec_id", "v", "home"])

    asked = keep(queries.select("rid", "vec_id", "v").mapInArrow(near_pivot, "rid long, vec_id long, v binary, home long"), "queries")
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}
    if not homes:
        return empty
    # pivots with few queries share a block, those with many have several
    block, filled, into = 0, 0, {}
    for h, n in sorted(homes.items()):
        if filled and filled + n > QUERY_ROWS:
            block, filled = block + 1, 0
        into[h] = block
        filled += n
    as_map = lambda found: F.create_map(*(x for h, n in sorted(found.items()) for x in (F.lit(int(h)), F.lit(int(n)))))[F.col("home")]
    asked = asked.withColumns({"block": as_map(into), "share": F.pmod(F.xxhash64("rid"), as_map({h: math.ceil(n / QUERY_ROWS) for h, n in homes.items()}))})

    def wanted(start: int, end: int):
        """Of each block of queries, and each annulus that one of them expands to in this pass, those queries."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            q = np.frombuffer(b"".join(pdf["v"]), store).reshape(-1, dim)
            x = q.astype(np.float64)
            best = reach(gaps(distances(np.column_stack((x, np.zeros(len(x)))), pivots), low, high), x, top)
            place = np.argsort(np.argsort(-best, axis=1, kind="stable"), axis=1, kind="stable")
            floor = pdf["floor"].to_numpy(np.int64)
            chosen = (place >= start) & (place < end) & (best >= floor[:, None])
            rids, ids = pdf["rid"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64)
            rows = [(int(cell_of[c]), *(x[own].tobytes() for x in (rids, ids, q, floor))) for c in np.flatnonzero(chosen.any(0)) for own in [np.flatnonzero(chosen[:, c])]]
            return pd.DataFrame(rows, columns=["cell", "q_rids", "q_ids", "q", "floors"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, m = (np.frombuffer(r[x], store).reshape(-1, dim) for x in ("q", "m"))
                rids, ids, q_rids, q_ids, floor = (np.frombuffer(r[x], np.int64) for x in ("rids", "ids", "q_rids", "q_ids", "floors"))
                s = products(q, m, q_rids[:, None] == rids[None])
                if len(ids) > k + 1:  # nothing below the block's own k+1st can matter
                    floor = np.maximum(floor, np.partition(s, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
                at, to = np.nonzero(s >= floor[:, None])
                other = q_rids[at] != rids[to]
                at, to = at[other], to[other]
                value = s[at, to]
                order = np.lexsort((to, -value, at))  # to: by vec_id already
                at, to, value = at[order], to[order], value[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                best = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(q_rids[at[best]]), pa.array(q_ids[at[best]]), pa.array(ids[to[best]]), pa.array(value[best])], ["query_rid", "query_id", "vec_id", "score"])

    best, found, start = W.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id"), None, 0
    floors = asked.withColumn("floor", F.lit(-(2**63) + 1))
    for end in PASSES:
        asks = floors.groupBy("block", "share")
        asks = keep(asks.applyInPandas(wanted(start, end), "cell long, q_rids binary, q_ids binary, q binary, floors binary"), "query-asks")
        if asks.isEmpty():
            break
        hits = asks.join(blocks, "cell").select("rids", "ids", "m", "q_rids", "q_ids", "q", "floors").mapInArrow(search, HIT)
        hits = hits if found is None else found.drop("rank").unionByName(hits)
        found = keep(hits.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}"), "best")
        kth = found.where(f"rank = {k}").select(F.col("query_rid").alias("rid"), F.col("score").alias("floor"))
        floors = asked.join(kth, "rid", "left").withColumn("floor", F.coalesce("floor", F.lit(-(2**63) + 1)))
        start = end
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose vec_id is divisible by 20."""
    small_batches(spark)
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS rid
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.rid AS q_rid, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY q_rid ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""
