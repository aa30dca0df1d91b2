"""Grids of heights as folders of binary tiles, read and written through Spark's data source interface.

A folder holds grid.json (size, tile side, affine numbers, sentinel) and one file for each
tile: its cells row by row as little-endian doubles, the sentinel where there is no data. A
tile is one partition; tiles that a window or a filter on r and c leaves out are never
opened. The header is written last, so a folder without one is a write that didn't finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from vantage.operators.grid import Grid

NAME = "vantage_tiles"
HEADER = "grid.json"
SENTINEL = -9999.0


def folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, by its scheme, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def header(path: str) -> dict:
    files, at = folder(path)
    with files.open_input_stream(f"{at}/{HEADER}") as f:
        return json.loads(f.read())


def grid_of(path: str) -> Grid:
    """The Grid header of a folder of tiles."""
    h = header(path)
    return Grid(**{k: h[k] for k in ("x0", "y0", "a", "e", "h", "w")})


class Tile(InputPartition):
    def __init__(self, tr: int, tc: int):
        self.tr, self.tc = tr, tc


class Bounds:
    """Whole-number bounds of r and c, both ends within."""

    def __init__(self, h: int, w: int):
        self.low, self.high = {"r": 0, "c": 0}, {"r": h - 1, "c": w - 1}

    def narrow(self, column: str, low: float | None = None, high: float | None = None) -> None:
        if low is not None:
            self.low[column] = max(self.low[column], int(np.ceil(low)))
        if high is not None:
            self.high[column] = min(self.high[column], int(np.floor(high)))

    def take(self, f: Filter) -> None:
        """Narrows by a comparison of r or c with a number; others say nothing about tiles."""
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return
        if len(f.attribute) != 1 or f.attribute[0] not in self.low or not isinstance(f.value, (int, float)):
            return
        column, v = f.attribute[0], f.value
        if isinstance(f, EqualTo):
            self.narrow(column, v, v)
        elif isinstance(f, GreaterThanOrEqual):
            self.narrow(column, low=v)
        elif isinstance(f, LessThanOrEqual):
            self.narrow(column, high=v)
        elif isinstance(f, GreaterThan):
            self.narrow(column, low=np.floor(v) + 1)
        else:
            self.narrow(column, high=np.ceil(v) - 1)

    def tiles(self, side: int) -> list[tuple[int, int]]:
        span = lambda k: range(self.low[k] // side, self.high[k] // side + 1) if self.low[k] <= self.high[k] else range(0)
        return [(tr, tc) for tr in span("r") for tc in span("c")]


class TileReader(DataSourceReader):
    def __init__(self, path: str, window: str | None):
        self.path, self.head = path, header(path)
        self.bounds = Bounds(self.head["h"], self.head["w"])
        if window:
            r0, r1, c0, c1 = map(int, window.split(","))
            self.bounds.narrow("r", r0, r1)
            self.bounds.narrow("c", c0, c1)

    def partitions(self) -> list[Tile]:
        return [Tile(tr, tc) for tr, tc in self.bounds.tiles(self.head["tile"])]

    def read(self, partition: Tile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no tile at all still is one task
            return
        side, h, w = self.head["tile"], self.head["h"], self.head["w"]
        r0, c0 = partition.tr * side, partition.tc * side
        rows, columns = min(side, h - r0), min(side, w - c0)
        files, at = folder(self.path)
        with files.open_input_stream(f"{at}/{tile_name(partition.tr, partition.tc)}") as f:
            z = np.frombuffer(f.read(), "<f8")
        if len(z) != rows * columns:
            raise ValueError(f"tile {partition.tr}, {partition.tc} of {self.path} has {len(z)} cells, not {rows * columns}")
        r, c = np.divmod(np.arange(rows * columns), columns)
        r, c = r + r0, c + c0
        low, high = self.bounds.low, self.bounds.high
        inside = (r >= low["r"]) & (r <= high["r"]) & (c >= low["c"]) & (c <= high["c"])
        r, c, z = r[inside], c[inside], z[inside]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(z, pa.float64(), mask=z == self.head["sentinel"])], ["r", "c", "z"])


class PushedTileReader(TileReader):
    """For sessions that push filters to Python sources, as one that takes filters is an error elsewhere."""

    def pushFilters(self, filters: list[Filter]):
        """Tiles are left out by all of them; Spark still applies each, as a tile is more than its window."""
        for f in filters:
            self.bounds.take(f)
            yield f


def tile_name(tr: int, tc: int) -> str:
    return f"tile_{tr}_{tc}.bin"


@dataclass
class Written(WriterCommitMessage):
    tiles: int


class TileWriter(DataSourceArrowWriter):
    """Writes a partition's tiles, each under a name of its own first, then moved: a task that runs again or twice leaves the same file."""

    def __init__(self, path: str, head: dict):
        self.path, self.head = path, head

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        side, h, w, sentinel = (self.head[k] for k in ("tile", "h", "w", "sentinel"))
        files, at = folder(self.path)
        files.create_dir(at, recursive=True)
        key, cells, n = None, None, 0

        def put() -> None:
            temporary = f"{at}/_{uuid.uuid4().hex}"
            with files.open_output_stream(temporary) as f:
                f.write(cells.astype("<f8").tobytes())
            files.move(temporary, f"{at}/{tile_name(*key)}")

        for batch in iterator:
            tr, tc, r, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("tr", "tc", "r", "c"))
            z = batch.column("z").to_numpy(zero_copy_only=False).astype(float)
            missing = np.asarray(batch.column("z").is_null())
            if (z[~missing] == sentinel).any():
                raise ValueError(f"a height equals the sentinel {sentinel}")
            # tiles come one after the other
            edges = np.flatnonzero(np.r_[True, (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1]), True]) if len(tr) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if key != (int(tr[a]), int(tc[a])):
                    if key is not None:
                        put()
                    key, n = (int(tr[a]), int(tc[a])), n + 1
                    cells = np.full((min(side, h - key[0] * side), min(side, w - key[1] * side)), sentinel)
                full = ~missing[a:b]
                cells[r[a:b][full].astype(int) - key[0] * side, c[a:b][full].astype(int) - key[1] * side] = z[a:b][full]
        if key is not None:
            put()
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        n = sum(m.tiles for m in messages if m)
        if n != self.head["tiles"]:
            raise ValueError(f"{n} tiles written, not {self.head['tiles']}")
        files, at = folder(self.path)
        with files.open_output_stream(f"{at}/{HEADER}") as f:
            f.write(json.dumps(self.head).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to do: without its header a folder isn't read, and a new write replaces its tiles."""


class TileSource(DataSource):
    """Options: path; window 'r0,r1,c0,c1', both ends within; pushdown, whether filters narrow the window; header (for writes)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "r int, c int, z double"

    def reader(self, schema: StructType) -> TileReader:
        return (PushedTileReader if self.options.get("pushdown") == "true" else TileReader)(self.options["path"], self.options.get("window"))

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"], json.loads(self.options["header"]))


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(r, c, z) of all cells, or of a window's (r0, r1, c0, c1, both ends within, cut to the grid); z is null where there is no data. Where the session pushes filters to Python sources, those on r and c leave out tiles too."""
    spark.dataSource.register(TileSource)
    reader = spark.read.format(NAME).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load(path)


def write_tiles(dem: DataFrame, grid: Grid, path: str, side: int = 1024, sentinel: float = SENTINEL) -> None:
    """dem (r, c, z) as a folder of tiles. Cells that it doesn't hold, or holds as null, have no data; cells off the grid are left out; of cells given twice one is kept. A height that equals the sentinel is an error, a folder that has a header too."""
    spark = dem.sparkSession
    files, at = folder(path)
    if files.get_file_info(f"{at}/{HEADER}").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    spark.dataSource.register(TileSource)
    down, across = -(-grid.h // side), -(-grid.w // side)
    head = {**asdict(grid), "tile": side, "sentinel": sentinel, "tiles": down * across}
    cells = dem.where(f"r BETWEEN 0 AND {grid.h - 1} AND c BETWEEN 0 AND {grid.w - 1}").select(F.floor(F.col("r") / side).cast("int").alias("tr"), F.floor(F.col("c") / side).cast("int").alias("tc"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z"))
    # a cell without data in each tile, so that every tile has its file
    every = spark.range(down * across).select(F.floor(F.col("id") / across).cast("int").alias("tr"), (F.col("id") % across).cast("int").alias("tc"))
    every = every.select("tr", "tc", (F.col("tr") * side).alias("r"), (F.col("tc") * side).alias("c"), F.lit(None).cast("double").alias("z"))
    placed = cells.unionByName(every).repartition("tr", "tc").sortWithinPartitions("tr", "tc", "r", "c", "z")
    placed.write.format(NAME).option("header", json.dumps(head)).mode("append").save(path)
