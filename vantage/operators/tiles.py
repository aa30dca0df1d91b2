"""Rays over a surface of any size: pieces of rays meet the tiles that they cross.

The surface is a row a tile: the heights of its cells and of the next row and column, so
that a bilinear sample needs one tile only. A ray is cut where its samples pass from one
tile to the next; the pieces, not the samples, are shuffled to their tiles, and each is
sampled there. Pieces go in waves of 1, 2, 4, ... tiles from the eye on; between waves a
ray carries what it has met so far, and one that is settled (its target is hidden, or it
has hit the ground) goes no further. A tile that many pieces cross is dealt to several
tasks, by the number of samples that it has to answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Grid
from .scratch import kept
from .surface import EPS, Surface, blocks

TILE = 128
#: Samples that one task answers in one tile, about.
PER_TASK = 1 << 22
_RAY = ("ex", "ey", "ez", "ux", "uy", "slope")


def tiled(four: DataFrame, tile: int = TILE) -> DataFrame:
    """tr, tc, tile, z: the surface's tiles, each (tile + 1) x (tile + 1) heights as bytes, NaN where a sample would be void; written down."""
    at = F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc")

    def pack(cells: pa.Table) -> pa.Table:
        tr, tc = cells.column("tr")[0].as_py(), cells.column("tc")[0].as_py()
        z = np.full((tile + 1, tile + 1), np.nan)
        i, j = cells.column("r").to_numpy() - tr * tile, cells.column("c").to_numpy() - tc * tile
        for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1)):
            z[i + di, j + dj] = cells.column(f"z{di}{dj}").to_numpy()
        return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), "tile": pa.array([tile], pa.int32()), "z": pa.array([z.tobytes()], pa.binary())})

    cells = four.select(*at, "r", "c", *(F.col(f"z{i}{j}").cast("double").alias(f"z{i}{j}") for i in (0, 1) for j in (0, 1)))
    # a group is a tile's cells, at most tile * tile
    return kept(cells.groupBy("tr", "tc").applyInArrow(pack, "tr int, tc int, tile int, z binary"))


def tiled_cells(dem: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """tiled() of a grid of whole size from its cells (r, c, z): a cell goes to its tile, and one on a tile's first row or column to the tiles before it too. A sample beside a missing cell is void, as its height is NaN."""
    at = lambda k, n: F.filter(F.array(F.floor(F.col(k) / tile).cast("int"), F.when(F.col(k) % tile == 0, F.floor(F.col(k) / tile).cast("int") - 1)), lambda t: (t >= 0) & (t * tile < n - 1))

    def pack(cells: pa.Table) -> pa.Table:
        tr, tc = cells.column("tr")[0].as_py(), cells.column("tc")[0].as_py()
        z = np.full((tile + 1, tile + 1), np.nan)
        z[cells.column("r").to_numpy() - tr * tile, cells.column("c").to_numpy() - tc * tile] = cells.column("z").to_numpy()
        return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), "tile": pa.array([tile], pa.int32()), "z": pa.array([z.tobytes()], pa.binary())})

    cells = dem.where("z IS NOT NULL").select("r", "c", F.col("z").cast("double").alias("z"), F.explode(at("r", grid.h)).alias("tr")).select("*", F.explode(at("c", grid.w)).alias("tc"))
    # a group is a tile's cells and those of the next row and column
    return kept(cells.groupBy("tr", "tc").applyInArrow(pack, "tr int, tc int, tile int, z binary"))


def sample_places(grid: Grid, step: float, ex, ey, ux, uy, first, last):
    """Ray, step, distance, fractional row and column of each sample of rays' steps first..last."""
    n = np.maximum(last - first + 1, 0)
    ray = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(ray)) - np.repeat(np.cumsum(n) - n, n) + first[ray]
    d = k * step
    x, y = ex[ray] + ux[ray] * d, ey[ray] + uy[ray] * d
    return ray, k, d, (y - grid.y0) / grid.e - 0.5, (x - grid.x0) / grid.a - 0.5


def horizon_in(ground: Surface, grid: Grid, step: float, ex, ey, ez, ux, uy, first, last) -> np.ndarray:
    """The steepest rise of the surface over rays' steps first..last, -inf where none has data."""
    out = np.full(len(ex), -np.inf)
    ray, _, d, rf, cf = sample_places(grid, step, ex, ey, ux, uy, first, last)
    rise = (ground.at(rf, cf) - ez[ray]) / d
    np.maximum.at(out, ray, np.where(np.isnan(rise), -np.inf, rise))
    return out


def met_in(ground: Surface, grid: Grid, step: float, ex, ey, ez, ux, uy, slope, first, last):
    """Of rays' steps first..last: the first one at or under the surface (0: none), the clearance there, the clearance at the last step with data before it (of all, if none is met), and that step."""
    ray, k, d, rf, cf = sample_places(grid, step, ex, ey, ux, uy, first, last)
    f = ground.at(rf, cf) - (ez[ray] + slope[ray] * d)
    never = np.iinfo(np.int64).max
    hit = np.full(len(ex), never)
    under = np.flatnonzero(f >= 0)
    np.minimum.at(hit, ray[under], k[under])
    there = np.flatnonzero(~np.isnan(f) & (k < hit[ray]))
    tail = np.full(len(ex), -1)
    np.maximum.at(tail, ray[there], there)  # samples of a ray are in order
    at_hit = np.flatnonzero(k == hit[ray])
    clear = np.full(len(ex), np.nan)
    clear[ray[at_hit]] = f[at_hit]
    known = tail >= 0
    before, step_before = np.full(len(ex), np.nan), np.zeros(len(ex), np.int64)
    before[known], step_before[known] = f[tail[known]], k[tail[known]]
    return np.where(hit == never, 0, hit), clear, before, step_before


def pieces(rays: DataFrame, grid: Grid, keys: list[str], step: float, tile: int, most: int) -> DataFrame:
    """Of rays (keys, ex, ey, ez, ux, uy, slope, next, last: the steps still to go) a row for each of the next `most` tiles: tr, tc, first, final."""
    # a straight line leaves a tile within so many steps
    longest = int(1.5 * tile * max(abs(grid.a), abs(grid.e)) / step) + 2
    names = [*keys, *_RAY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _RAY}
            low = batch.column("next").to_numpy(zero_copy_only=False)
            high = np.minimum(batch.column("last").to_numpy(zero_copy_only=False), low + most * longest - 1)
            for part in blocks(high - low + 1):
                ray, k, _, rf, cf = sample_places(grid, step, *(col[c][part] for c in ("ex", "ey", "ux", "uy")), low[part], high[part])
                if not len(ray):
                    continue
                tr, tc = np.floor(np.floor(rf) / tile).astype(np.int32), np.floor(np.floor(cf) / tile).astype(np.int32)
                begin = np.flatnonzero(np.concatenate(([True], (np.diff(ray) != 0) | (np.diff(tr) != 0) | (np.diff(tc) != 0))))
                own = ray[begin]
                place = np.arange(len(begin)) - np.searchsorted(own, own)
                end = np.append(begin[1:], len(ray)) - 1
                some = place < most
                begin, end = begin[some], end[some]
                rows = batch.take(pa.array(ray[begin] + part.start))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(tr[begin]), pa.array(tc[begin]), pa.array(k[begin]), pa.array(k[end])], [*names, "tr", "tc", "first", "final"])

    kinds = {f.name: f.dataType.simpleString() for f in rays.schema}
    return rays.select(*names, "next", "last").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", tr int, tc int, first long, final long")


def _answered(some: DataFrame, surface: DataFrame, keys: list[str], answer: Callable, schema: str) -> DataFrame:
    """answer(ground, columns) for pieces at their tiles; tiles with many samples are dealt to several tasks."""
    load = some.groupBy("tr", "tc").agg(F.sum(F.col("final") - F.col("first") + 1).alias("n")).select("tr", "tc", F.ceil(F.col("n") / PER_TASK).cast("int").alias("shares"))
    dealt = some.join(load, ["tr", "tc"]).withColumn("share", F.pmod(F.xxhash64(*keys), F.col("shares")).cast("int")).drop("shares")
    there = surface.join(load, ["tr", "tc"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            tile = right.column("tile")[0].as_py()
            z = np.frombuffer(right.column("z")[0].as_py()).reshape(tile + 1, tile + 1)
            ground = Surface(z, right.column("tr")[0].as_py() * tile, right.column("tc")[0].as_py() * tile)
        else:
            ground = Surface(np.full((2, 2), np.nan), 0, 0)
        col = {c: left.column(c).to_numpy() for c in ("first", "final")} | {c: left.column(c).cast(pa.float64()).to_numpy() for c in _RAY}
        parts = [answer(ground, {c: x[part] for c, x in col.items()}) for part in blocks(col["final"] - col["first"] + 1)] or [answer(ground, col)]
        out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        as_array = lambda x: pa.array(x, mask=np.isnan(x)) if x.dtype == float else pa.array(x)
        return pa.Table.from_arrays([*(left.column(c) for c in (*keys, "first", "final")), *map(as_array, out.values())], [*keys, "first", "final", *out])

    kinds = {f.name: f.dataType.simpleString() for f in some.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    by = ["tr", "tc", "share"]
    return dealt.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(run, f"{head}, first long, final long, {schema}")


def _side(surface: DataFrame) -> int:
    row = surface.select("tile").first()
    return row["tile"] if row else TILE


def line_of_sight(rays: DataFrame, surface: DataFrame, grid: Grid, keys: list[str], step: float = 1.0, d_min: float = 1.0) -> DataFrame:
    """rays (keys, ex, ey, ez, tx, ty, tz) with dist and visible, over tiled() surface."""
    dx, dy = F.col("tx") - F.col("ex"), F.col("ty") - F.col("ey")
    rays = rays.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    begin = max(1, -(-int(d_min * 1_000_000) // int(step * 1_000_000)))
    last = F.floor((F.col("dist") - d_min) / step).cast("long")
    rise = (F.col("tz") - F.col("ez")) / F.col("dist")
    unit = {"ux": dx / F.col("dist"), "uy": dy / F.col("dist"), "slope": F.lit(0.0), "rise": rise}
    going = kept(rays.where((last >= begin) & F.col("tz").isNotNull()).withColumns(unit | {"next": F.lit(begin).cast("long"), "last": last, "horizon": F.lit(None).cast("double")}).select(*keys, *_RAY, "rise", "next", "last", "horizon"))
    tile, wave, hidden = _side(surface), 1, None

    def answer(ground: Surface, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        top = horizon_in(ground, grid, step, c["ex"], c["ey"], c["ez"], c["ux"], c["uy"], c["first"], c["final"])
        return {"top": np.where(np.isneginf(top), np.nan, top)}

    while not going.isEmpty():
        met = _answered(kept(pieces(going, grid, keys, step, tile, wave)), surface, keys, answer, "top double")
        upto = met.groupBy(*keys).agg(F.max("top").alias("top"), F.max("final").alias("final"))
        carried = kept(going.join(upto, keys).withColumns({"horizon": F.greatest("horizon", "top"), "next": F.col("final") + 1}).drop("top", "final"))
        below = F.coalesce(F.col("rise") < F.col("horizon") - EPS, F.lit(False))
        out = carried.where(below).select(*keys)
        hidden = out if hidden is None else hidden.unionByName(out)
        going = kept(carried.where(~below & (F.col("next") <= F.col("last"))))
        wave *= 2
    blind = hidden.withColumn("_hidden", F.lit(True)) if hidden is not None else rays.select(*keys).limit(0).withColumn("_hidden", F.lit(True))
    return rays.join(blind, keys, "left").withColumn("visible", (F.col("dist") > 0) & F.col("tz").isNotNull() & F.col("_hidden").isNull()).drop("_hidden")


def first_hit(rays: DataFrame, surface: DataFrame, grid: Grid, keys: list[str], step: float, last: int) -> DataFrame:
    """rays (keys, ex, ey, ez, ux, uy, slope) with _k, _f and _before: the first of `last` steps at or under the tiled() surface, the clearance there, and that at the last step with data before it."""
    going = kept(rays.select(*keys, *_RAY).withColumns({"next": F.lit(1).cast("long"), "last": F.lit(last).cast("long"), "_before": F.lit(None).cast("double")}))
    tile, wave, hits = _side(surface), 1, None

    def answer(ground: Surface, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        k, f, before, _ = met_in(ground, grid, step, *(c[x] for x in _RAY), c["first"], c["final"])
        return {"_k": k, "_f": f, "_tail": before}

    while last > 0 and not going.isEmpty():
        met = _answered(kept(pieces(going, grid, keys, step, tile, wave)), surface, keys, answer, "_k long, _f double, _tail double")
        # a wave's pieces of a ray are no more than its tiles; after the first hit none counts
        each = F.array_sort(F.collect_list(F.struct("first", F.col("_k").alias("k"), F.col("_f").alias("f"), F.col("_tail").alias("before"))))
        start = F.struct(F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("before"))

        def step_on(acc, x):
            now = F.struct(F.when(x["k"] > 0, x["k"]).alias("k"), F.when(x["k"] > 0, x["f"]).alias("f"), F.coalesce(x["before"], acc["before"]).alias("before"))
            return F.when(acc["k"].isNotNull(), acc).otherwise(now)

        upto = met.groupBy(*keys).agg(F.max("final").alias("final"), F.aggregate(each, start, step_on).alias("m"))
        carried = kept(going.join(upto, keys).select(*keys, *_RAY, (F.col("final") + 1).alias("next"), "last", F.col("m.k").alias("_k"), F.col("m.f").alias("_f"), F.coalesce("m.before", "_before").alias("_before")))
        out = carried.where("_k IS NOT NULL").select(*keys, "_k", "_f", "_before")
        hits = out if hits is None else hits.unionByName(out)
        going = kept(carried.where("_k IS NULL AND next <= last").drop("_k", "_f"))
        wave *= 2
    if hits is None:
        return rays.withColumns({"_k": F.lit(None).cast("long"), "_f": F.lit(None).cast("double"), "_before": F.lit(None).cast("double")})
    return rays.join(hits, keys, "left")
