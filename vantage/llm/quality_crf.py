"""Document quality from a linear-chain conditional random field over lines.

Each line is good (1) or bad (0). Its features are counts of its own make-up (length,
capitals, digits, symbols, bars, exclamation marks, repeated words, an end in sentence
punctuation, ...), cut into steps, and the same steps of the lines before and after it.
The chain adds a weight for each pair of neighbouring labels. Forward and backward sums
give each line's marginal probability of being good; a document's score is their mean,
weighted by line length.

Labels are on documents only. Training first takes a document's label as that of all its
lines and maximizes the conditional likelihood of the chain, with all four pairs of
neighbouring labels free, on at most SAMPLE_GOOD and SAMPLE_BAD labelled documents. Then,
RELABELS times, the lines of bad documents that look good by their own make-up alone are
labelled good, as long as some stay bad, and the chain is fitted anew, so good lines next
to bad ones are seen (by default none are: where a label holds for a whole document, that
scores documents better). Last an intercept is set on the document's score. A document with more
than TRAIN_LINES lines is trained on as several chains of that many, so no line is left
out; scoring runs over the whole document at once.

Cases: null and empty texts, and texts of white space, are one empty line, scored like
any other; a document counts as labelled if any of its rows is not null and as good if
any says so; null ids are rows of their own; without labels of both kinds every score
is the share of good labels; lines that repeat are lines of their own, and one equal to
an earlier one is marked; a very long text is held whole, with some ten numbers a line;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import text_slices, word_hashes, words_of
from .shared import bounded_labels, crc_rest, documents

SAMPLE_GOOD, SAMPLE_BAD = 2500, 2500
TRAIN_LINES = 64
ROUNDS = 150
RIDGE = 1e-3
RELABELS = 0
THRESHOLD = 0.3
#: Steps of each line count: shares of bytes or words, and lengths.
STEPS = {
    "words": (1, 3, 6, 12, 25, 50),
    "upper": (0.02, 0.1, 0.3, 0.6),
    "digit": (0.01, 0.05, 0.2),
    "symbol": (0.001, 0.02, 0.08),
    "bar": (0.001, 0.03),
    "exclaim": (0.001, 0.03),
    "stop": (0.005, 0.03),
    "repeat": (0.1, 0.3, 0.5, 0.7, 0.9),
    "word_length": (3, 4, 6, 9),
    "open_end": (0.5,),
    "same_line": (0.5,),
}
BASE = sum(map(len, STEPS.values()))
FEATURES = 3 * BASE + 1
_KIND = np.zeros((256, 6), bool)
_KIND[65:91, 0] = True
_KIND[48:58, 1] = True
_KIND[[ord(c) for c in "#*$%&<>{}[]\\^~=_+@/"], 2] = True
_KIND[ord("|"), 3] = True
_KIND[ord("!"), 4] = True
_KIND[[ord(c) for c in ".,;:?"], 5] = True


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x BASE steps as 0/1, line lengths in bytes, each text's first line: texts + 1) of a slice."""
    breaks = np.flatnonzero(data == 10) + 1
    # a line starts at each text's start and after each break inside it; a break that ends a text opens a last, empty line
    text = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks - 1, "right") - 1))
    begin = np.concatenate((offsets[:-1], breaks))
    order = np.lexsort((begin, text))
    text, begin = text[order], begin[order]
    first = np.searchsorted(text, np.arange(len(offsets)))
    last = np.zeros(len(begin), bool)
    last[first[1:] - 1] = True
    end = np.where(last, offsets[text + 1], np.append(begin[1:], 0) - 1)
    size = np.maximum(end - begin, 0)
    # counts of byte kinds by differences of running sums, one kind at a time
    per = {}
    for k, name in enumerate(("upper", "digit", "symbol", "bar", "exclaim", "stop")):
        total = np.concatenate(([0], np.cumsum(_KIND[data, k], dtype=np.int32)))
        per[name] = (total[end] - total[begin]) / np.maximum(size, 1)
    starts, stops, _ = words_of(data, offsets)
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, np.maximum(end, begin))
    words = b - a
    line = np.repeat(np.arange(len(begin)), words)
    hashes = word_hashes(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
    code = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    distinct = np.bincount(np.unique(line * (1 << 32) + code) >> 32, minlength=len(begin)) if len(line) else np.zeros(len(begin))
    per["words"] = words
    per["repeat"] = 1 - distinct / np.maximum(words, 1) * (words > 0) - (words == 0)
    long = np.concatenate(([0], np.cumsum(stops - starts)))
    per["word_length"] = (long[b] - long[a]) / np.maximum(words, 1)
    final = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(begin), np.uint8)
    per["open_end"] = ((size > 0) & ~_KIND[final, 5]).astype(float)
    summed = np.bincount(line, (code & 0xFFFFFF) * 1.0, len(begin)) if len(line) else np.zeros(len(begin))
    key = np.stack((text, size, summed.astype(np.int64)), 1)
    by = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
    same = np.zeros(len(begin), bool)
    same[by[1:]] = (key[by[1:]] == key[by[:-1]]).all(1)
    per["same_line"] = (same & (words > 0)).astype(float)
    steps = np.stack([per[name] >= s for name, cuts in STEPS.items() for s in cuts], 1)
    return steps, size, first


def with_neighbours(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """lines x FEATURES: a constant, the line's steps, and those of the lines before and after it in its text."""
    out = np.zeros((len(steps), FEATURES), np.float32)
    out[:, 0] = 1
    out[:, 1 : 1 + BASE] = steps
    starts = np.zeros(len(steps) + 1, bool)
    starts[first] = True
    if len(steps) > 1:
        out[1:, 1 + BASE : 1 + 2 * BASE] = steps[:-1] * ~starts[1:-1, None]
        out[:-1, 1 + 2 * BASE :] = steps[1:] * ~starts[1:-1, None]
    return out


def side_by_side(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line of each place, step bounds): places go step by step through all chains together, the longest chain first."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], first[:-1][order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), "right")
    bases = np.concatenate(([0], np.cumsum(active)))
    chain = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(chain)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line = np.empty(len(chain), np.int64)
    line[bases[step] + chain] = begins[chain] + step
    return line, bases


def chain_sums(unary: np.ndarray, pair: np.ndarray, bases: np.ndarray, rate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (places x 2), summed pair expectations (2 x 2) and summed log partition of all chains, each chain by its rate. unary: log potentials of good and bad by place; rate: by place, alike within a chain."""
    rate = np.ones(len(unary)) if rate is None else rate
    peak = unary.max(1, keepdims=True)
    u = np.exp(unary - peak)
    t = np.exp(pair)
    fwd, bwd = np.empty_like(u), np.ones_like(u)
    steps = len(bases) - 1
    norm = np.empty(len(u))
    for k in range(steps):
        a, b = bases[k], bases[k + 1]
        now = u[a:b] if not k else u[a:b] * (fwd[bases[k - 1] : bases[k - 1] + b - a] @ t)
        norm[a:b] = now.sum(1)
        fwd[a:b] = now / norm[a:b, None]
    expected = np.zeros((2, 2))
    for k in range(steps - 2, -1, -1):
        a, c, d = bases[k], bases[k + 1], bases[k + 2]
        right = u[c:d] * bwd[c:d]
        back = right @ t.T
        joint = fwd[a : a + d - c, :, None] * t * right[:, None, :]
        expected += (joint / joint.sum((1, 2), keepdims=True) * rate[c:d, None, None]).sum(0)
        bwd[a : a + d - c] = back / back.sum(1, keepdims=True)
    marginal = fwd * bwd
    return marginal / marginal.sum(1, keepdims=True), expected, float((rate * (np.log(norm) + peak[:, 0])).sum())


@dataclass(frozen=True)
class Chain:
    weights: np.ndarray  # FEATURES: log odds of good
    pair: np.ndarray  # 2 x 2
    scale: float
    shift: float

    def marginals(self, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each line to be good."""
        x = with_neighbours(steps, first) @ self.weights.astype(np.float32)
        line, bases = side_by_side(first)
        marginal, _, _ = chain_sums(np.stack((np.zeros(len(x)), x.astype(np.float64)), 1)[line], self.pair, bases)
        out = np.empty(len(x))
        out[line] = marginal[:, 1]
        return out

    def documents(self, steps: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of each text's marginals, then the fitted intercept."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        weight = size + 1.0
        mean = np.bincount(text, weight * self.marginals(steps, first), len(first) - 1) / np.bincount(text, weight, len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * (mean - 0.5) + self.shift, -40, 40)))


def loss(theta: np.ndarray, xs: np.ndarray, label: np.ndarray, rate: np.ndarray, bases: np.ndarray) -> tuple[float, np.ndarray]:
    """Less the chains' weighted conditional log-likelihood, and its gradient. By place: xs, label (0 or 1), rate. theta: FEATURES, then the four pairs."""
    pair = theta[-4:].reshape(2, 2)
    logit = (xs @ theta[:-4].astype(xs.dtype)).astype(float)
    marginal, expected, partition = chain_sums(np.stack((np.zeros(len(logit)), logit), 1), pair, bases, rate)
    seen, worth = np.zeros((2, 2)), float((rate * label * logit).sum())
    for k in range(len(bases) - 2):
        a, c, d = bases[k], bases[k + 1], bases[k + 2]
        np.add.at(seen, (label[a : a + d - c], label[c:d]), rate[c:d])
    worth += float((seen * pair).sum())
    return partition - worth, np.concatenate((((marginal[:, 1] - label) * rate) @ xs, (expected - seen).reshape(-1)))


def climb(xs: np.ndarray, label: np.ndarray, rate: np.ndarray, bases: np.ndarray, theta: np.ndarray) -> np.ndarray:
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for k in range(1, ROUNDS + 1):
        grad = loss(theta, xs, label, rate, bases)[1] + RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta


def train(steps: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray) -> Chain:
    """y: each text's label. Texts of both kinds weigh the same in total, and each text the same whatever its lines."""
    lines = np.diff(first)
    label = np.repeat(y, lines)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    cuts = np.unique(np.concatenate([first, *(np.arange(a, b, TRAIN_LINES) for a, b in zip(first, first[1:]) if b - a > TRAIN_LINES)]))
    text = np.repeat(np.arange(len(lines)), lines)
    line, bases = side_by_side(cuts)
    xs, rate = with_neighbours(steps, first)[line], (share / lines)[text][line]
    theta = climb(xs, label[line], rate, bases, np.zeros(FEATURES + 4))
    for _ in range(RELABELS):
        good = theta[0] + steps @ theta[1 : 1 + BASE] >= 0
        bad_left = np.bincount(text, ~good, len(lines)) > 0
        label = np.where((label == 0) & good & bad_left[text], 1, label)
        theta = climb(xs, label[line], rate, bases, theta)
    chain = Chain(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    mean = np.bincount(text, (size + 1.0) * chain.marginals(steps, first), len(lines)) / np.bincount(text, size + 1.0, len(lines)) - 0.5
    scale, shift = 4.0, 0.0
    for _ in range(400):
        g = (1 / (1 + np.exp(-np.clip(scale * mean + shift, -40, 40))) - y) * share
        scale, shift = max(0.5, scale - 4 * (g * mean).sum() - 0.004 * (scale - 8)), shift - 2 * g.sum()
    return Chain(chain.weights, chain.pair, scale, shift)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Chain:
    ids = bounded_labels(labels, column, SAMPLE_GOOD, SAMPLE_BAD)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in text_slices(batch.column("text")):
                steps, size, first = line_features(data, offsets)
                packed = np.packbits(steps, axis=1)
                cuts = list(zip(first, first[1:]))
                yield pa.RecordBatch.from_arrays([pa.array([packed[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([size[a:b].astype(np.int32).tobytes() for a, b in cuts], pa.binary()), batch.column("y").slice(at, n)], ["steps", "size", "y"])

    rows = sample.mapInArrow(features, "steps binary, size binary, y int").toPandas()
    y = rows["y"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        odds = float(np.log((y.sum() + 1e-3) / (len(y) - y.sum() + 1e-3))) if len(y) else 0.0
        return Chain(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, odds)
    # the same order of rows whatever order tasks end in
    order = np.array(sorted(range(len(y)), key=lambda k: (y[k], bytes(rows["size"][k]), bytes(rows["steps"][k]))))
    rows, y = rows.iloc[order], y[order]
    size = np.concatenate([np.frombuffer(x, np.int32) for x in rows["size"]]).astype(np.int64)
    width = (BASE + 7) // 8
    steps = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, width), axis=1)[:, :BASE] for x in rows["steps"]]).astype(bool)
    first = np.concatenate(([0], np.cumsum([len(x) // 4 for x in rows["size"]])))
    return train(steps, size, first, y)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and score (0 to 1) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for at, n, data, offsets in text_slices(batch.column("text")):
                z[at : at + n] = chain.documents(*line_features(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def label_lines(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and lines: of each line its length in bytes, the probability that it is good, and the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, data, offsets in text_slices(batch.column("text")):
                steps, size, first = line_features(data, offsets)
                good = chain.marginals(steps, first)
                rows += [[{"length": int(n), "p_good": float(p), "good": bool(p >= 0.5)} for n, p in zip(size[a:b], good[a:b])] for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("length", pa.int32()), ("p_good", pa.float64()), ("good", pa.bool_())])))], ["doc_id", "lines"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lines array<struct<length:int,p_good:double,good:boolean>>")


def held_out(doc_id):
    return crc_rest(doc_id, 5) == 0


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
