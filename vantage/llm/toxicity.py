"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of characters of the lower-case text, present or not. An n-gram's ratio is
the log of how much more often toxic documents of the sample hold it than others, with
add-one counts. Kept are the n-grams whose ratio is at least Z standard errors from 0.
A logistic regression on the ratios of a document's n-grams then weighs them; its
weights are drawn towards their mean, as is usual for this pair of models.

The model is fitted on at most SAMPLE_TOXIC toxic and SAMPLE_OTHER other labelled rows.
In the regression a row stands for as many as its kind's sampling left out, so that the
share of toxic rows is that of all labels, whatever their number. The weights are one
table of fixed size, whatever the corpus.

Cases: null and empty texts score what the intercept alone gives; a text counts as
labelled if any of its label rows is not null, and as toxic if any says so; null ids
are rows of their own; without labels of both kinds all scores are the share of toxic
labels; an n-gram counts once a text however often it stands there, so ties and repeats
make no difference; a very long text is gone through in parts, with what stands over
their seams, and only its features are held; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import SPACE, as_strings, code_points, text_parts
from .shared import bounded_labels, crc_rest, documents, keep

GRAMS = (4, 5, 6)
DIMS = 1 << 20
SAMPLE_TOXIC, SAMPLE_OTHER = 3000, 6000
Z = 4.0
RIDGE = 0.02
ROUNDS = 300
#: Share of the learned weights, against their mean.
BETA = 0.75
#: Bytes of text whose n-grams are listed at once.
SLICE = 1 << 20
#: Features of the sample that a gradient step takes at once.
STEP = 1 << 20
#: Bytes on each side of a cut that no n-gram is longer than.
SEAM = 24


def gram_buckets(code: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of characters and the place of each; none reaches over two texts."""
    m = max(0, len(code) - n + 1)
    hashed = np.full(m, n, np.uint32)
    for k in range(n):
        hashed *= np.uint32(0x01000193)
        hashed += code[k : k + m]
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x2C1B3C6D)
    hashed ^= hashed >> np.uint32(13)
    inside = np.ones(m, bool)
    for b in offsets[1:-1]:
        inside[max(0, b - n + 1) : b] = False
    at = np.flatnonzero(inside)
    return (hashed[at] & np.uint32(DIMS - 1)).astype(np.int64), at


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, each once, of the buckets that are wanted. White space counts as blank."""
    lower = pc.utf8_lower(as_strings(data, offsets))
    _, bounds, raw = lower.buffers()
    bounds = np.frombuffer(bounds, np.int64)[: len(offsets)]
    data = np.frombuffer(raw, np.uint8)[: bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    code, starts = code_points(data)
    code[(code < 33) & SPACE[code & 0xFF]] = 32
    offsets = np.searchsorted(starts, bounds)
    rows, buckets = [], []
    for n in GRAMS:
        found, at = gram_buckets(code, offsets, n)
        if wanted is not None:
            hit = wanted[found]
            found, at = found[hit], at[hit]
        rows.append(np.searchsorted(offsets, at, "right") - 1)
        buckets.append(found)
    pair = np.unique(np.concatenate(rows) * DIMS + np.concatenate(buckets))
    return pair // DIMS, pair % DIMS


def features_of(column: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) pairs of a column of texts, sorted by row, slice by slice; each pair once. Texts that go through many parts come last."""
    part = SLICE // 4
    long = pc.fill_null(pc.greater(pc.binary_length(column), part), False).to_numpy(zero_copy_only=False)
    held: dict[int, np.ndarray] = {}
    for owner, data, offsets in text_parts(column, SLICE, part, SEAM):
        row, bucket = present(data, offsets, wanted)
        row = owner[row]
        for k in np.unique(row[long[row]]):
            held[int(k)] = np.union1d(held.get(int(k), bucket[:0]), bucket[row == k])
        yield row[~long[row]], bucket[~long[row]]
    for k, bucket in held.items():
        yield np.full(len(bucket), k), bucket


def logistic(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept; x: each document's feature numbers, weight: how many rows it stands for. Full gradient steps with momentum."""
    row = np.repeat(np.arange(len(x), dtype=np.int32), [len(a) for a in x])
    col = np.concatenate(x) if len(x) else np.zeros(0, np.int32)
    parts = [(row[k : k + STEP], col[k : k + STEP]) for k in range(0, len(col), STEP)]
    weight = weight / weight.mean()
    toxic = (weight * y).sum()
    w, bias = np.ones(len(ratio)), float(np.log((toxic + 1) / (len(y) - toxic + 1)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        own, z, slope = ratio * w, np.full(len(x), bias), np.zeros(len(ratio))
        for a, b in parts:
            z += np.bincount(a, own[b], len(x))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        for a, b in parts:
            slope += np.bincount(b, g[a], len(ratio))
        grad = np.append(ratio * slope / len(x) + ridge * w / max(1, len(ratio)), g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the intercept. docs: doc_id, text; labels: doc_id and a 0/1 column."""
    ids = bounded_labels(labels, column, SAMPLE_TOXIC, SAMPLE_OTHER)
    sample = keep(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y", "rate").repartition(8), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            total = np.zeros((2, DIMS), np.int64)
            for row, bucket in features_of(batch.column("text"), None):
                for k in (0, 1):
                    total[k] += np.bincount(bucket[y[row] == k], minlength=DIMS)
            used = np.flatnonzero(total.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1, used]), pa.array(total[0, used])], ["bucket", "toxic", "other"])

    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    table = np.zeros(DIMS, np.float32)
    if not n1 or not n0:
        return table, float(np.log((n1 + 1e-3) / (n0 + 1e-3))) if n1 + n0 else 0.0
    p, q = F.col("toxic") + 1, F.col("other") + 1
    ratio = F.log(p / (n1 + 2)) - F.log(q / (n0 + 2))
    error = F.sqrt(1 / p + 1 / q)
    # both standard errors count: add-one keeps a rare n-gram's ratio small
    kept = (
        sample.mapInArrow(count, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) / error).alias("z")).where(F.col("z") >= Z).orderBy("bucket").toPandas()
    )
    ratio_of, number = kept["ratio"].to_numpy(), np.full(DIMS, -1)
    number[kept["bucket"]] = np.arange(len(kept))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b""] * batch.num_rows
            for row, bucket in features_of(batch.column("text"), number >= 0):
                cuts = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
                for a, b in zip(cuts, cuts[1:]):
                    found[row[a]] = number[bucket[a:b]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("y"), batch.column("rate")], ["x", "y", "rate"])

    rows = sample.mapInArrow(features, "x binary, y int, rate double").toPandas()
    w, bias = logistic([np.frombuffer(a, np.int32) for a in rows["x"]], rows["y"].to_numpy(np.float64), ratio_of, 1 / rows["rate"].to_numpy())
    w = BETA * w + (1 - BETA) * np.abs(w).mean() if len(w) else w
    table[kept["bucket"]] = w * ratio_of
    return table, bias


def score(docs: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score (0 to 1) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        wanted = weights != 0
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for row, bucket in features_of(batch.column("text"), wanted):
                z += np.bincount(row, weights[bucket], len(z))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id):
    return crc_rest(doc_id, 5) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = score(docs, *fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
