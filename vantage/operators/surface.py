"""A gridded surface as an array in a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept

EPS = 1e-6
#: Cells, holes included, of a surface that is sent to executors: 32 MB.
SURFACE_CELLS = 4_000_000
#: Samples that a task holds at once.
SAMPLES = 1 << 20


def blocks(n: np.ndarray, most: int = SAMPLES) -> Iterator[slice]:
    """Slices of rows that make n samples each, with about so many samples."""
    upto = np.concatenate(([0], np.cumsum(n)))
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        yield slice(a, b)
        a = b


@dataclass(frozen=True)
class Surface:
    """Heights by row and column from (r0, c0) on, NaN where there is none."""

    z: np.ndarray
    r0: int
    c0: int

    def at(self, rf: np.ndarray, cf: np.ndarray) -> np.ndarray:
        """Bilinear heights at fractional rows and columns; NaN where a corner is missing."""
        r, c = np.floor(rf), np.floor(cf)
        wr, wc = rf - r, cf - c
        i, j = r.astype(np.int64) - self.r0, c.astype(np.int64) - self.c0
        inside = (i >= 0) & (j >= 0) & (i + 1 < self.z.shape[0]) & (j + 1 < self.z.shape[1])
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        z = (self.z[i, j] * (1 - wc) + self.z[i, j + 1] * wc) * (1 - wr) + (self.z[i + 1, j] * (1 - wc) + self.z[i + 1, j + 1] * wc) * wr
        return np.where(inside, z, np.nan)


def small_surface(four: DataFrame, most: int = SURFACE_CELLS) -> Surface | None:
    """The surface as an array, or None if its bounding rectangle holds more cells than most."""
    four = kept(four.select("r", "c", "z00", "z01", "z10", "z11"))
    b = four.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")).first()
    if b["r0"] is None:
        return Surface(np.full((2, 2), np.nan), 0, 0)
    h, w = b["r1"] - b["r0"] + 2, b["c1"] - b["c0"] + 2
    if h * w > most:
        return None
    z, rows = np.full((h, w), np.nan), four.toPandas()
    i, j = rows["r"].to_numpy() - b["r0"], rows["c"].to_numpy() - b["c0"]
    for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1)):
        z[i + di, j + dj] = rows[f"z{di}{dj}"]
    return Surface(z, b["r0"], b["c0"])
