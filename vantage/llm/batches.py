"""Arrow batches as flat NumPy arrays: bytes, words and their hashes.

All work on a batch goes through slices of bounded bytes, so a batch of very long
texts needs no more memory for its temporaries than one of short texts.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Longer texts are cut into parts of about so many bytes.
PART_BYTES = 1 << 18
_LIBC = ctypes.CDLL(None) if os.name == "posix" else None
#: Odd multipliers and table seeds of the hashes: any fixed values do, as long as all tasks use the same.
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Hands freed memory back to the system: a worker that is used again then starts small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2^64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


_POWERS: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, kept by the worker."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        _POWERS["up"], _POWERS["down"] = powers(n), powers(n, inverse(WORD_BASE))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, UTF-8 bytes, row offsets into them); null is empty; at most so many bytes unless one text is longer."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    give_back()


def cut_before(data: np.ndarray, start: int, end: int) -> int:
    """The last place in the later half of start..end at which white space begins a part; else end, moved to the start of a character."""
    half = start + (end - start) // 2
    blanks = np.flatnonzero(SPACE[data[half:end]])
    if len(blanks):
        return half + int(blanks[-1])
    while end > start + 1 and data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def text_parts(column: pa.Array, most: int = SLICE_BYTES, part: int = PART_BYTES, seam: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, UTF-8 bytes, part offsets into them), at most about so many bytes at once. A text is one part unless it is longer than part. With seam, so many bytes on both sides of each cut come once more, as a part of their own."""
    for at, n, data, offsets in text_slices(column, most):
        if not (np.diff(offsets) > part).any():
            yield np.arange(at, at + n), data, offsets
            continue
        owner, cuts = [], [0]
        for k in range(n):
            a, b = int(offsets[k]), int(offsets[k + 1])
            while b - a > part:
                a = cut_before(data, a, a + part)
                if seam:
                    low, high = max(int(offsets[k]), a - seam), min(b, a + seam)
                    low += int(np.argmax(data[low:high] & 0xC0 != 0x80))
                    yield np.array([at + k]), data[low:high], np.array([0, high - low])
                owner.append(at + k)
                cuts.append(a)
            owner.append(at + k)
            cuts.append(b)
        owner, cuts = np.array(owner), np.array(cuts)
        i = 0
        while i < len(owner):
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + most, "right")) - 1)
            yield owner[i:j], data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]
            i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't ASCII white space), and each row's first word: len(rows) + 1."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid[1:] & (~solid[:-1] | edge)
    starts = np.flatnonzero(begins[:n])
    stops = solid[:-1] & (~solid[1:] | edge)
    ends = np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from running sums over parts of bounded size; a word may reach over several."""
    total = np.zeros(len(starts), np.uint64)
    for low in range(0, len(data), part):
        high = min(low + part, len(data))
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high)
        if a >= b:
            continue
        up, down = power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_CODES[data[low:high]] * up[:-1], out=sums[1:])
        first = np.maximum(starts[a:b] - low, 0)
        own = (sums[np.minimum(ends[a:b], high) - low] - sums[first]) * down[first]
        if starts[a] < low:  # goes on from the part before
            own[:1] *= np.uint64(pow(int(WORD_BASE), low - int(starts[a]), 1 << 64))
        total[a:b] += own
    return mix64(total + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def as_strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The stretches between bounds (ascending, covering data) as an Arrow string array, without a copy of the bytes."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and where each begins; a character that the end cuts off is what is there of it."""
    starts = np.flatnonzero(data & 0xC0 != 0x80)
    lead = data[starts].astype(np.uint32)
    extra = (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(extra == 0, lead, lead & (0x7F >> (extra + 1)))
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    for k in (1, 2, 3):
        more = np.flatnonzero(extra >= k)
        code[more] = code[more] << 6 | (padded[starts[more] + k] & 0x3F)
    return code.astype(np.uint32), starts
