"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Documents with equal sets are one class from the start. Two similar sets share enough of
their first tokens in any one order: a set of n tokens may miss n - ceil(0.8 n) of them.
Here the order is by frequency class, rare first, and within a class by hash. The prefix
is extended until it covers one token more than may be missed, where

- a token of the rare class covers one, and is indexed alone;
- tokens of frequent classes are dealt into groups by hash and indexed in combinations of
  k of a group (two, and three for the most frequent ones), so a group with m of them in
  the prefix covers m - k + 1.

Then similar sets share a token or a combination. The number of groups follows the band
of sizes that a set belongs to, whatever its size; a set whose smaller partners may belong
to the band below is indexed in both. Sets of less than four tokens are similar to equal
ones only.

Classes come from counts of all shingles in a sketch of SKETCH counters: a token is
frequent if its counter stands FREQUENT standard deviations above the mean. Any classes
give right results; good ones keep the lists short.

Lists of the index are worked through in rounds. First each class is held against one
leader, the smallest class that it shares a list with; then, in lists that still hold
several components, against the list's member with the fewest rare tokens, as a base has
fewer of them than its edits. A list of more than LONG classes that is
still open is not paired but indexed once more, by what its sets have different from the
leader's: X and Y are similar if 9 |X ^ Y| <= |X| + |Y|, and X ^ Y is also the difference
of their differences from the leader. If neither shares enough of these, both are similar
to the leader or they are not similar. So edits of one base, which have nearly all tokens
in common, are told apart by their edits. Only in short lists, and in those that ROUNDS
such steps could not make shorter, pairs of different components are looked at, as far as
their places in the order leave room for enough common tokens; sizes and counts by hash
bucket drop most of these before whole sets are compared.

Tokens are 64-bit hashes of 5-word sequences, and classes 64-bit hashes of sets.

Cases: null text and text without words have an empty set and are linked to nothing;
with one to four words the whole sequence is the one shingle; a very long text is hashed
in parts of bounded size, but its set is held whole; rows that repeat a doc_id are
documents of their own; the component of a document with a null id is that of the
group's smallest other id, null if there is none; an empty table gives no rows; other
columns, whatever their names, are ignored by similar_groups() and kept by
first_of_groups(), where of equal rows the first in the order of the files stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import lower_ascii, mix64, powers, text_slices, word_hashes, words_of
from .components import components
from .shared import documents, keep, quoted

SHINGLE = 5
PERCENT = 80
SKETCH = 1 << 22
CHUNKS = 64
FREQUENT = 4.0
#: Levels of frequency from which combinations are of two and of three tokens.
PAIRS, TRIPLES = 1, 6
#: Open lists of more classes are indexed by differences, at most so many times over.
LONG, ROUNDS = 64, 2
#: Bits of the filter on sets to fetch; a full filter only fetches more.
FILTER_BITS = 1 << 23
#: Tokens of a set to each bucket of its counts, at most.
BUCKET = 8
_STEP = powers(SHINGLE + 1, np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    data = lower_ascii(data)
    starts, ends, firsts = words_of(data, offsets)
    words = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    m = max(0, len(words) - SHINGLE + 1)
    windows = np.full(m, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        windows += words[k : k + m] * _STEP[k]
    windows = mix64(windows)
    out = []
    for a, b in zip(firsts, firsts[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix64(np.array([mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def may_miss(n: int) -> int:
    return n - -(-PERCENT * n // 100)


def bucket_counts(tokens: np.ndarray) -> bytes:
    """Counts of a set's tokens by hash bucket, as many buckets as a power of two needs for BUCKET tokens each; empty if one passes a byte."""
    size = 1 << max(0, (len(tokens) - 1) // BUCKET).bit_length()
    counts = np.bincount((tokens >> np.uint64(24)).astype(np.int64) & (size - 1), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_share(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    """Whether two sets' bucket counts allow the similarity."""
    if not x or not y:
        return True
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in ((x, y) if len(x) <= len(y) else (y, x)))
    both = int(np.minimum(a, b.reshape(-1, len(a)).sum(0)).sum())
    return 100 * both >= PERCENT * (nx + ny - both)


def band(n: int) -> int:
    return n.bit_length() - 1


def combinations(tokens: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k tokens of one group. tokens keep their order within a group."""
    by = np.argsort(group, kind="stable")
    tokens, group = tokens[by], group[by]
    found = []

    def extend(last: np.ndarray, hashed: np.ndarray, left: int) -> None:
        if left == 0:
            found.append(hashed)
            return
        step = 1
        while True:
            on = last + step
            fits = on < len(tokens)
            fits[fits] = group[on[fits]] == group[last[fits]]
            if not fits.any():
                return
            extend(on[fits], mix64(hashed[fits]) * np.uint64(0x9E3779B97F4A7C15) + tokens[on[fits]], left - 1)
            last, hashed, step = last[fits], hashed[fits], step + 1

    extend(np.arange(len(tokens)), tokens + np.uint64(k), k - 1)
    return mix64(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a set is indexed under, and each one's place in the order (0 for combinations). frequent: each token's level, 0 for rare."""
    n = len(tokens)
    if n < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    need = may_miss(n) + 1
    order = np.argsort(frequent, kind="stable")  # tokens are sorted by hash already
    ranked, level = tokens[order], frequent[order]
    rare = min(int(np.searchsorted(level, PAIRS)), need)
    out, places = [ranked[:rare]], [np.arange(rare)]
    if rare < need:
        ranked, level = ranked[rare:], level[rare:]
        three = level >= TRIPLES
        for b in {band(n), band(-(-PERCENT * n // 100))}:
            twos, threes = max(1, (1 << b) // 8), max(1, (1 << b) // 16)
            group = np.where(three, twos + ((ranked >> np.uint64(40)) % np.uint64(threes)).astype(np.int64), ((ranked >> np.uint64(40)) % np.uint64(twos)).astype(np.int64))
            by = np.argsort(group, kind="stable")
            sizes = np.bincount(group, minlength=twos + threes)
            nth = np.empty(len(ranked), np.int64)
            nth[by] = np.arange(len(ranked)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            covered = rare + np.cumsum(nth >= np.where(three, 2, 1))
            taken = int(np.searchsorted(covered, need)) + 1
            for k, own in ((2, ~three[:taken]), (3, three[:taken])):
                found = combinations(ranked[:taken][own], group[:taken][own], k) ^ np.uint64(b)
                out.append(found)
                places.append(np.zeros(len(found), np.int64))
    return np.concatenate(out), np.concatenate(places)


def profiles(docs: DataFrame) -> DataFrame:
    """Of each document doc_id, n, class and bucket counts; and of each task its sketch in chunks (chunk, counts)."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "n", "class", "buckets", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, id_type = np.zeros(SKETCH, np.int64), set(), None
        for batch in batches:
            n, own, buckets = [], [], []
            id_type = batch.column("doc_id").type
            for _, _, data, offsets in text_slices(batch.column("text")):
                new = []
                for tokens in shingle_sets(data, offsets):
                    n.append(len(tokens))
                    own.append(class_of(tokens))
                    buckets.append(bucket_counts(tokens) if len(tokens) else b"")
                    if own[-1] not in seen:
                        seen.add(own[-1])
                        new.append(tokens)
                if new:
                    at, times = np.unique((np.concatenate(new) & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
                    total[at] += times
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(buckets, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if id_type is not None:
            whole = total.astype("<u2" if total.max() < 1 << 16 else "<u8")
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(whole, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, id_type), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n long, class long, buckets binary, chunk int, counts binary")


def levels(sketches: DataFrame) -> np.ndarray:
    """Each counter's level: 0 for rare, then by powers of two of its excess. The tasks' sketches are added up chunk by chunk."""
    size = SKETCH // CHUNKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                raw = zlib.decompress(counts.as_py())
                total[chunk] = total.get(chunk, 0) + np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["chunk", "counts"])

    rows = sketches.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    total = np.zeros((CHUNKS, size), np.int64)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    total = total.reshape(-1)
    mean = total.mean()
    excess = (total - mean) / max(1.0, np.sqrt(mean)) / FREQUENT
    return np.where(excess > 1, np.minimum(1 + np.log2(np.maximum(excess, 1)), 30), 0).astype(np.uint8)


def index(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(sig, class, at) rows, a class once a task; at is the set's size and, in the low half, the place in its order. Each class has one more row, of a sig of its own and ~at, with the number of its rare tokens instead of a place."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = shared.value, set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                sigs, owner, at = [], [], []
                for tokens in shingle_sets(data, offsets):
                    if len(tokens) and (own := class_of(tokens)) not in seen:
                        seen.add(own)
                        level_of = of[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
                        sig, place = signatures(tokens, level_of)
                        sigs.append(np.append(sig, np.array([own], np.int64).view(np.uint64)))
                        at.append(np.append((len(tokens) << 32) + place, ~((len(tokens) << 32) + (level_of < PAIRS).sum())))
                        owner.append(own)
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(owner, np.int64), [len(s) for s in sigs])), pa.array(np.concatenate(at))], ["sig", "class", "at"])

    return docs.select("text").mapInArrow(run, "sig long, class long, at long")


def fetch_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, tokens of the classes in wanted, and of some others that pass its filter."""
    bit = F.pmod("class", F.lit(FILTER_BITS))
    rows = wanted.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    words = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for r in rows:
        words[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                owner, kept = [], []
                for tokens in shingle_sets(data, offsets):
                    if not len(tokens):
                        continue
                    own = class_of(tokens)
                    # bucket numbers count from 1 and positions from 0, but bucket 1 starts at bit 1
                    at = own % FILTER_BITS
                    k, p = (1 + (at - 1) // 32768, (at - 1) % 32768) if at > 0 else (0, -at)
                    if own not in seen and bits[k, p // 8] >> (p % 8) & 1:
                        seen.add(own)
                        owner.append(own)
                        kept.append(tokens.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(kept, pa.binary())], ["class", "tokens"])

    return docs.select("text").mapInArrow(run, "class long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= PERCENT * max(len(x), len(y)) else 0
                good.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    left, right = sets.select(F.col("class").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
    return keep(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def possible(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bucket counts allow, written down. listed: class, n, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, na, nb = (batch.column(c).to_pylist() for c in ("x", "y", "na", "nb"))
            good = pa.array([may_share(*v) for v in zip(x, y, na, nb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    a = listed.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("buckets").alias("x"))
    b = listed.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("buckets").alias("y"))
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return keep(near.select("a", "b", "x", "y", "na", "nb").mapInArrow(run, "a long, b long"), "possible")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, tokens of the classes in wanted, and of few others, each once; written down."""
    if wanted.isEmpty():
        return docs.sparkSession.createDataFrame([], "class long, tokens binary")
    return keep(fetch_sets(docs, wanted).dropDuplicates(["class"]), "sets")


def differences(x: np.ndarray, y: np.ndarray, level_x: np.ndarray, level_y: np.ndarray) -> tuple[np.ndarray, int]:
    """Of a set x and its leader's y: the tokens of only one, those first that few sets of the leader's lists should differ in, as far as a partner can need them; and their number."""
    new, gone = ~np.isin(x, y, assume_unique=True), ~np.isin(y, x, assume_unique=True)
    tokens = np.concatenate((x[new], y[gone] ^ np.uint64(0x8000000000000000)))
    # few sets have a new token that is rare; few sets lack a token of the leader's that is frequent
    most = 2.0 ** (level_y.max() if len(y) else 0)
    cost = np.concatenate((2.0 ** level_x[new], np.maximum(most - 2.0 ** level_y[gone], max(most / 8, 1.5))))
    d, linked = len(tokens), 9 * len(tokens) <= len(x) + len(y)
    until = -(-(9 * d + len(x) - len(y)) // 18) if linked else len(x) // 4 + 1
    return tokens[np.lexsort((tokens, cost))][: max(0, until)], d


def narrowed(led: DataFrame, sets: DataFrame, level: np.ndarray) -> DataFrame:
    """Lists by differences. led: leader, class. Rows sig, class, n, d, place, late, or those with a null sig for classes similar to their leader.

    late: the place is of use only together with a set that is similar to the leader. Places of those go to half their differences only, as a partner is none.
    """
    shared = led.sparkSession.sparkContext.broadcast(level)
    names = ["sig", "leader", "class", "n", "d", "place", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            rows = []
            for leader, own, x, y in zip(batch.column("leader").to_pylist(), batch.column("class").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                tokens, d = differences(x, y, *(of[(v & np.uint64(SKETCH - 1)).astype(np.int64)] for v in (x, y)))
                places = np.arange(len(tokens))
                sigs = mix64(tokens ^ mix64(np.array([leader], np.int64).view(np.uint64)))
                linked = 9 * d <= len(x) + len(y)
                rows.append((sigs.view(np.int64), own, leader, len(x), d, places, (18 * places >= 9 * d + len(x) - len(y)) & (not linked), linked and own != leader))
            sizes = [len(r[0]) for r in rows]
            whole = lambda k: np.repeat(np.array([r[k] for r in rows], np.int64), sizes)
            if sum(sizes):
                columns = [np.concatenate([r[0] for r in rows]), whole(2), whole(1), whole(3), whole(4), np.concatenate([r[5] for r in rows]), np.concatenate([r[6] for r in rows])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
            links = [r for r in rows if r[7]]
            m = len(links)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array([r[2] for r in links], pa.int64()), pa.array([r[1] for r in links], pa.int64()), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.bool_())], names)

    both = led.join(sets.select("class", F.col("tokens").alias("x")), "class").join(sets.select(F.col("class").alias("leader"), F.col("tokens").alias("y")), "leader")
    return keep(both.select("leader", "class", "x", "y").mapInArrow(run, "sig long, leader long, class long, n long, d long, place long, late boolean"), "narrowed")


def still_open(rows: DataFrame, labels: DataFrame, rare: DataFrame) -> DataFrame:
    """The rows of lists that hold several components and a place that isn't late, with each one's component, the list's length and its leader, which has the fewest rare tokens. rows: sig, class, n, d, place, late; rare: class, rare."""
    by_sig = W.partitionBy("sig")
    known = rows.select("sig", "class", "n", "d", "place", "late").join(labels.select(F.col("node").alias("class"), "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    known = known.join(rare, "class")
    known = known.withColumns({"leader": F.min(F.struct("rare", "class", "comp")).over(by_sig), "low": F.min("comp").over(by_sig), "high": F.max("comp").over(by_sig), "length": F.count("*").over(by_sig), "early": F.min("late").over(by_sig)})
    return keep(known.where("low <> high AND NOT early").drop("low", "high", "early", "rare"), "open-lists")


def across(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a list and of different components that have room for enough common tokens after the place of the first."""
    x, y = (lists.select("sig", F.col("class").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("comp", "n", "d", "place", "late"))) for k in "ab")
    room = f"18 * least(d_a - place_a, d_b - place_b) >= 9 * (d_a + d_b) - (n_a + n_b) AND 100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"
    return x.join(y, "sig").where(f"a < b AND comp_a <> comp_b AND NOT (late_a AND late_b) AND {room}").select("a", "b").distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id. docs: doc_id, text; read three to four times."""
    measured = keep(profiles(docs), "profiles")
    members = measured.where("chunk IS NULL").select("doc_id", "n", "class", "buckets")
    by_sig = W.partitionBy("sig")
    level = levels(measured.where("chunk IS NOT NULL").select("chunk", "counts"))
    lists = index(docs, level).withColumns({"leader": F.min("class").over(by_sig), "last": F.max("class").over(by_sig)}).where("leader <> last OR at < 0").select("sig", "class", "at", "leader")
    lists = keep(lists, "lists")
    lists, rare = lists.where("at >= 0"), lists.where("at < 0").groupBy("class").agg(F.max(F.bitwise_not("at") % (1 << 32)).alias("rare"))
    listed = members.where("n > 0").join(lists.select("class").distinct(), "class", "left_semi").select("class", "n", "buckets")
    listed = keep(listed.groupBy("class").agg(F.max("n").alias("n"), F.max("buckets").alias("buckets")), "listed")
    rare = keep(rare.join(listed.select("class"), "class", "left_semi"), "rare")

    one = possible(lists.groupBy("class").agg(F.min("leader").alias("a")).where("a <> class").select("a", F.col("class").alias("b")), listed)
    labels = components(verified(one, sets_of(docs, ends(one))))
    size = F.shiftright("at", 32)
    lists = still_open(lists.select("sig", "class", size.alias("n"), size.alias("d"), (F.col("at") % (1 << 32)).alias("place"), F.lit(False).alias("late")), labels, rare)
    led = possible(lists.where("leader.comp <> comp").select(F.col("leader.class").alias("a"), F.col("class").alias("b")).distinct(), listed)
    sets = sets_of(docs, ends(led).union(lists.where(f"length > {LONG}").select("class")))
    labels = components(verified(led, sets), labels)
    lists, rest = still_open(lists, labels, rare), []
    for _ in range(ROUNDS):
        long = lists.where(f"length > {LONG}")
        if long.isEmpty():
            break
        rest.append(lists.where(f"length <= {LONG}"))
        rows = narrowed(long.select(F.col("leader.class").alias("leader"), "class").distinct(), sets, level)
        labels = components(rows.where("sig IS NULL").select(F.col("leader").alias("a"), F.col("class").alias("b")), labels)
        lists = still_open(rows.where("sig IS NOT NULL"), labels, rare)
    for part in rest:
        lists = lists.unionByName(part)
    last = possible(across(still_open(lists, labels, rare) if rest else lists), listed)
    labels = components(verified(last, sets_of(docs, ends(last))), labels)

    labels = labels.select(F.col("node").alias("class"), "comp")
    grouped = members.where("n > 0").join(labels, "class", "left").select("doc_id", "n", F.coalesce("comp", "class").alias("comp"))
    smallest = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = grouped.join(smallest, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of similar ones: the first in the order of its files. Numbers are written down with the rows, as another reading could split the files otherwise."""
    numbered = keep(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*quoted(docs.columns)).alias("row")), "numbered")
    firsts = similar_groups(numbered.select("doc_id", F.col("row.text").alias("text"))).where("doc_id = component_id").select("doc_id")
    return numbered.join(firsts, "doc_id", "left_semi").select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


#: All pairs that share a shingle, and the smallest id that each document reaches.
OP3_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM worded
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM sets UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""
