"""Periodic runs of a text's words, by Lyndon roots.

A run is a stretch of consecutive words with smallest period q, at least twice as long as
that and at least `least` words, which no neighbouring word extends. Every run has, under
one of two orders of the words (any order and its reverse), a root that is the longest
Lyndon word at its place. The first phase of Baier's suffix sorter gives those lengths
directly: suffixes lie in groups of equal context; from the highest group down, each
member hands its group's context to the nearest earlier suffix of a lower group, and
suffixes that get it equally often go on as one group; the final context is the longest
Lyndon word. Roots are extended on both sides by longest common extensions, found by
hashes of stretches and held against the words themselves.

The phase takes a step a word in plain Python, so it gets only stretches that can hold a
run: each word of a run lies in one of its stretches of least / 2 words that comes twice
within the run. Words that no repeated stretch covers end a part, and parts are looked at
again until nothing more goes. Nothing that may be a run is left out.

Words are compared by 64-bit hashes of their bytes. A text is a row's own work: no
shuffle.

Cases: null and empty texts have no runs and an empty collapsed text; null and repeated
ids are rows of their own; no ties (a run is known by its start and period); an empty
table gives no rows; a very long text is one row's work in memory in proportion to its
length; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let
from .batches import mix64, power_tables, text_slices, word_hashes, words_of
from .shared import WORD_CLASS, crc32_sql, documents

LEAST = 12
#: Words whose bytes are gathered at once.
BLOCK = 1 << 16
RUN = "struct<start:long,length:long,period:long>"


def context_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of a sequence of numbers: the group contexts after the sorter's first phase."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.concatenate(([True], np.diff(symbols[order]) != 0)) if n else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    heads = np.empty(n, np.int32)
    heads[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    sizes = np.zeros(n, np.int32)
    sizes[begin] = np.diff(np.append(begin, n))
    places = np.empty(n, np.int32)
    places[order] = np.arange(n)
    # groups are neighbours in member, in order; head is where a suffix's group begins
    member, place, head, size = (array("i", x.astype(np.int32).tobytes()) for x in (order, places, heads, sizes))
    length, earlier, done = array("i", [1]) * n, array("i", range(-1, n - 1)), bytearray(n)

    def lower(i: int) -> int:
        """The nearest suffix before i whose group is still to come, or -1."""
        j = i - 1
        while j >= 0 and done[j]:
            k = earlier[j]
            if k >= 0 and done[k]:
                earlier[j] = earlier[k]
            j = k
        earlier[i] = j
        return j

    def to_end(j: int) -> None:
        """Takes j out of its group, to the place behind what is left of it."""
        g = head[j]
        size[g] -= 1
        at = g + size[g]
        here, other = place[j], member[at]
        member[here], member[at] = other, j
        place[other], place[j] = here, at

    end = n
    while end:
        last = member[end - 1]
        start = head[last]
        context = length[last]
        if end - start == 1:
            done[last] = 1
            j = lower(last)
            if j >= 0:
                length[j] += context
                to_end(j)
                at = place[j]
                head[j] = at
                size[at] = 1
        else:
            own = member[start:end]
            for i in own:
                done[i] = 1
            times: dict[int, int] = {}
            for i in own:
                j = lower(i)
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, k in times.items():
                by_times.setdefault(k, []).append(j)
            for k in sorted(by_times, reverse=True):
                some = by_times[k]
                for j in some:
                    length[j] += k * context
                    to_end(j)
                fresh = [head[j] + size[head[j]] for j in some]
                for at in set(fresh):
                    size[at] = 0
                for j, at in zip(some, fresh):
                    head[j] = at
                    size[at] += 1
        end = start
    return np.frombuffer(length, np.int32).astype(np.int64) if n else np.zeros(0, np.int64)


def extensions(symbols: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far symbols agree to the right from i and j on, and to the left before them; i < j. Never too short; too long only if hashes of different stretches are equal."""
    n = len(symbols)
    up, down = power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(symbols) * up[:n], out=sums[1:])
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        more = right + step
        fits = np.flatnonzero(j + more <= n)
        a, b, to = i[fits], j[fits], more[fits]
        right[fits[(sums[a + to] - sums[a]) * down[a] == (sums[b + to] - sums[b]) * down[b]]] += step
        more = left + step
        fits = np.flatnonzero(more <= i)
        a, b, to = i[fits], j[fits], more[fits]
        left[fits[(sums[a] - sums[a - to]) * down[a - to] == (sums[b] - sums[b - to]) * down[b - to]]] += step
        step >>= 1
    return right, left


def holds(symbols: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether start..end has the period and no neighbour goes on with it."""
    if not np.array_equal(symbols[start : end - period], symbols[start + period : end]):
        return False
    return (start == 0 or symbols[start - 1] != symbols[start - 1 + period]) and (end == len(symbols) or symbols[end] != symbols[end - period])


def stretched(symbols: np.ndarray, i: int, period: int) -> tuple[int, int]:
    """Start and end of the stretch round i..i + period that has the period, word by word."""
    differ = np.flatnonzero(symbols[:-period] != symbols[period:])
    k = int(np.searchsorted(differ, i))
    left = int(differ[k - 1]) + 1 if k else 0
    return left, (int(differ[k]) if k < len(differ) else len(symbols) - period) + period


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """start, length, period of every run of a sequence of small numbers, in order of start and period."""
    n, found = len(symbols), []
    for keys in (symbols, symbols.max() - symbols) if n >= max(2, least) else ():
        period = context_lengths(keys)
        i = np.flatnonzero(np.arange(n) + period < n)
        j = i + period[i]
        alike = (symbols[i] == symbols[j]) | ((i > 0) & (symbols[i - 1] == symbols[j - 1]))
        i, j = i[alike], j[alike]
        right, left = extensions(symbols, i, j)
        long = right + left >= np.maximum(j - i, least - (j - i))
        found.append(np.stack((i - left, j + right, j - i, i), 1)[long])
    if not found or not sum(map(len, found)):
        return np.zeros((0, 3), np.int64)
    roots = np.concatenate(found)
    known, which = np.unique(roots[:, :3], axis=0, return_inverse=True)
    wrong = [k for k, (a, b, q) in enumerate(known) if not holds(symbols, a, b, q)]
    if wrong:
        again = roots[np.isin(which.ravel(), wrong)]
        mended = [(*stretched(symbols, i, q), q) for _, _, q, i in again]
        mended = [(a, b, q) for a, b, q in mended if b - a >= max(least, 2 * q)]
        known = np.unique(np.concatenate((np.delete(known, wrong, 0), np.array(mended, np.int64).reshape(-1, 3))), axis=0)
    known[:, 1] -= known[:, 0]
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def repeating_parts(codes: np.ndarray, part: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Words that may lie in a run, and the part of each: neighbours within one part of the given ones, all covered by stretches of least // 2 words that come twice in it."""
    gram = max(1, least // 2)
    at = np.arange(len(codes))
    while len(at) >= least:
        x = codes[at]
        m = len(at) - gram + 1
        key = np.zeros(m, np.uint64)
        for k in range(gram):
            key = key * np.uint64(0x9E3779B97F4A7C15) + x[k : k + m]
        key = mix64(key + mix64(part[:m].astype(np.uint64)))
        whole = np.flatnonzero(part[:m] == part[gram - 1 :])
        key = key[whole]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, whole[twice], 1)
        np.add.at(edge, whole[twice] + gram, -1)
        covered = np.cumsum(edge[:-1]) > 0
        left = at[covered]
        if not len(left):
            break
        old = part[covered]
        begins = np.concatenate(([True], (np.diff(left) != 1) | (np.diff(old) != 0)))
        fresh = np.cumsum(begins) - 1
        long = np.bincount(fresh)[fresh] >= least
        if long.all() and len(left) == len(at):
            return left, fresh
        at, part = left[long], fresh[long]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def runs_of_rows(codes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Of words' codes and each row's first word: rows and runs (start in the row, length, period)."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, part = repeating_parts(codes, row, least)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    _, symbols = np.unique(codes[at], return_inverse=True)
    # parts stand one behind the other, with a number of its own after each: no run reaches over that
    shifted = np.arange(len(at)) + part
    line = symbols.max() + 1 + np.arange(len(at) + part[-1] + 1)
    line[shifted] = symbols
    origin = np.zeros(len(line), np.int64)
    origin[shifted] = at
    runs = runs_of(line, least)
    begin = origin[runs[:, 0]]
    rows = row[begin]
    return rows, np.stack((begin - first[rows], runs[:, 1], runs[:, 2]), 1)


def kept_words(first: np.ndarray, rows: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Words that no run repeats: those outside all runs and those of a run's first period."""
    edge = np.zeros(first[-1] + 1, np.int64)
    begin = first[rows] + runs[:, 0]
    np.add.at(edge, begin + runs[:, 2], 1)
    np.add.at(edge, begin + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each row's kept words, with one blank between."""
    words = np.flatnonzero(kept)
    row = np.searchsorted(first, words, "right") - 1
    blank = np.concatenate(([False], np.diff(row) == 0))
    sizes = ends[words] - starts[words] + blank
    total = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(total[-1], 32, np.uint8)
    for low in range(0, len(words), BLOCK):
        some = slice(low, low + BLOCK)
        n = sizes[some] - blank[some]
        skip = np.cumsum(n) - n
        each = np.arange(n.sum())
        out[np.repeat(total[:-1][some] + blank[some] - skip, n) + each] = data[np.repeat(starts[words[some]] - skip, n) + each]
    bounds = total[np.searchsorted(words, first)]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period) and collapsed: the text's words without those that a run repeats."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = words_of(data, offsets)
                rows, runs = runs_of_rows(word_hashes(data, starts, ends), first, least)
                text = joined(data, starts, ends, first, kept_words(first, rows, runs))
                each = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
                bounds = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.ListArray.from_arrays(bounds, each), text], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, runs array<{RUN}>, collapsed string")


def with_copies(doc_id: Column, text: Column) -> Column:
    """The text, or for every tenth crc32 of the id its words with all from a place on made periodic."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        new = let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])))))
        return F.when(n > 0, F.array_join(new, " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(f"{WORD_CLASS}+"), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are made periodic first."""
    docs = documents(spark, sf_dir)
    found = find_runs(docs.select("doc_id", with_copies(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))
    b = F.col("best")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-b["start"]).alias("start"), b["length"].alias("length"), (-b["period"]).alias("period"),
        F.floor(1000 * b["length"] / -b["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP12_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD_CLASS}+'), CAST([] AS VARCHAR[])) AS words, {crc32_sql("doc_id")} AS h FROM documents
), planned AS (
  SELECT doc_id, words, h % 10 = 0 AND len(words) > 0 AS made, len(words) AS n, h // 10 AS g FROM hashed
), placed AS (
  SELECT *, CASE WHEN made THEN g % n END AS a, CASE WHEN made THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM planned
), numbered AS (
  SELECT doc_id, n, made, a, p, words, unnest(range(n)) AS i FROM placed
), tokens AS (
  SELECT doc_id, n, i, words[1 + CASE WHEN made AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM numbered
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, {LEAST} - q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), digests AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    min_by(struct_pack(start := start, length := length, period := period), row(-length, start, period)) AS best
  FROM runs GROUP BY doc_id
), spans AS (
  SELECT doc_id, start + period AS low, start + length AS high FROM runs
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(low, high)) AS i FROM spans
), texts AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM tokens ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN digests USING (doc_id) LEFT JOIN texts USING (doc_id)
"""
