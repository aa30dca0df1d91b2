"""Packing documents into sequences of a fixed length by best-fit decreasing.

A document's ids, with a closing id, are first cut into full windows, each a sequence
of its own. The rest of each document, shorter than a window, goes to best-fit
decreasing: from the longest on, each into the open window with the least room that
holds it, which a segment tree over remaining capacities finds in as many steps as the
capacity has bits.

Rests are dealt evenly, whatever their keys, over shards of at most SHARD_ROWS, each
packed by one task; a shard leaves a window or two with room, of thousands.

Cases: null text is empty, and an empty document is its closing id alone; null or
repeated doc_ids are rows of their own; an empty table gives no rows; other columns
are ignored, whatever their names; ties in length go by doc_id, then by place. A special
token's string in a text is that token, as in a plain call of the tokenizer. A very long
text is tokenized in parts, cut where no token can reach across, so only its ids are held
whole.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import SPACE, as_strings, give_back, text_slices
from .shared import documents, keep

WINDOW = 2048
END_ID = 1
SHARD_ROWS = 16_384
#: Units of text, and their bytes, that a worker remembers the ids of, over tasks too; beyond, it starts afresh. Results don't depend on it.
CACHE_UNITS, CACHE_BYTES = 600_000, 24 << 20
#: Bytes of text whose units are told apart together.
SLICE = 4 << 20


#: Cut before these where a letter precedes: they belong to no pre-token of letters, and begin their own.
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".,;:!?|)"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class UnitTokenizer:
    """Ids by a byte-level BPE file, whose pre-tokens never reach from a visible character to white space, or from a letter to a stop.

    A text is cut there into units; equal units have equal ids, so each is tokenized once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def learn(self, names: list[str]) -> None:
        """Numbers new units and appends their ids."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))))
        self.held += sum(map(len, names))
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(lengths)))

    def units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the units. Letters here are ASCII's and those of U+00C0 to U+00FF; before white space any visible ASCII will do."""
        mark = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            wide = np.zeros(len(data), bool)
            wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            letter = _LETTER[data] | wide
            seen = (data > 0x20) & (data < 0x7F) | wide
            mark[1:-1] = SPACE[data[1:]] & seen[:-1] | _STOPS[data[1:]] & letter[:-1]
        for a, b in self.specials(data, offsets):
            mark[a + 1 : b] = False
            mark[[a, b]] = True
        mark[offsets] = True
        mark[len(data)] = False
        return np.flatnonzero(mark)

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens' strings stand, the leftmost first; none reaches over two rows."""
        raw = data.tobytes() if self.special and len(data) else b""
        found, at = [], 0
        while hits := [(k, -len(x)) for x in self.special if (k := raw.find(x, at)) >= 0]:
            a, n = min(hits)
            b = a - n
            if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left"):
                found.append((a, b))
                at = b
            else:
                at = a + 1
        return found

    def parts(self, data: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """A text in parts that begin at units' starts; longer ones only where there is no unit to cut at."""
        reach = max([64, *map(len, self.special)])
        at = 0
        while len(data) - at > most:
            low, high = max(at, at + most - reach), at + most + reach
            while True:
                window = data[low : min(high, len(data))]
                starts = self.units(window, np.array([0, len(window)]))
                # a special string that the window cuts off could begin or end elsewhere
                inner = starts[(starts >= min(reach, at + most - low)) & (starts <= len(window) - reach)]
                if len(inner) or high >= len(data):
                    break
                high += most
            if not len(inner):
                break
            yield data[at : low + inner[0]]
            at = low + int(inner[0])
        yield data[at:]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and where each row's ids begin: len(rows) + 1."""
        starts = self.units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = as_strings(data, np.append(starts, len(data))).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_UNITS or self.held > CACHE_BYTES:
            self.forget()
        if new := [x for x in names if x not in self.known]:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        begin = self.first[number]
        counts = self.first[number + 1] - begin
        upto = np.concatenate(([0], np.cumsum(counts)))
        source = np.repeat(begin - upto[:-1], counts)
        source += np.arange(len(source))
        return self.flat[source], upto[np.searchsorted(starts, offsets)]


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """One per worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = UnitTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): full windows, then the rest, of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for at, n, data, offsets in text_slices(batch.column("text"), SLICE):
                if n == 1:
                    flat = np.concatenate([own.encode(x, np.array([0, len(x)]))[0] for x in own.parts(data, SLICE)])
                    bounds = np.array([0, len(flat)])
                else:
                    flat, bounds = own.encode(data, offsets)
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for k in range(n):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), window):
                        piece = ids[s : s + window]
                        row.append(at + k)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                        if with_ids:
                            kept.append(piece.astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the order given (longest first)."""
    base = 1 << window.bit_length()
    tree = bytearray(2 * base)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, made = [], [], 0
    for need in lengths:
        i = base + need
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i > 1:
                i += 1
                while i < base:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
        if i > 1:
            room = i - base
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                while i and tree[i]:
                    tree[i] = i < base and (tree[2 * i] or tree[2 * i + 1])
                    if tree[i]:
                        break
                    i >>= 1
        else:
            room, bin_ = window, made
            made += 1
        bins.append(bin_)
        offsets.append(window - room)
        left = room - need
        if left:
            open_bins[left].append(bin_)
            i = base + left
            while i and not tree[i]:
                tree[i] = 1
                i >>= 1
    return bins, offsets


def pack(cut: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """cut (the result of pieces(), written down) with sequence_id and offset."""
    whole = cut.where(F.col("length") == window).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    rests = cut.where(F.col("length") < window)
    shards = max(1, math.ceil(rests.count() / shard_rows))
    dealt = rests.repartition(shards).withColumn("sequence_id", F.spark_partition_id().cast("long")).withColumn("offset", F.lit(0).cast("long"))
    names = dealt.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(table.column("length").to_pylist(), window)
        shard = table.column("sequence_id")[0].as_py()
        ids = (np.array(bins, np.int64) + (np.int64(shard) << 33)) * 2 + 1
        table = table.set_column(names.index("sequence_id"), "sequence_id", pa.array(ids)).set_column(names.index("offset"), "offset", pa.array(offsets, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    return whole.unionByName(dealt.mapInArrow(fit, dealt.schema))


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence with its ids; needs pieces(..., with_ids=True). A sequence is at most a window."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select("sequence_id", F.flatten(F.transform("rows", lambda r: r["ids"])).alias("ids"), F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["start"].alias("start"), r["offset"].alias("offset"))).alias("pieces"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(keep(pieces(documents(spark, sf_dir), default_path()), "pieces"))
