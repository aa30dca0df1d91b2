"""Sources: tolerant CSV, meshes in OBJ, tagged drawings in DXF, manifests, page texts, PDF streams.

Text formats are read as lines with their place in the file; records are put together
with windows, so a large file is no single row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column a string; no file gives no rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def typed(rows: DataFrame, types: dict[str, str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows cast where they can be; those whose required columns can't be are rejected as they came."""
    cast = {c: F.expr(f"try_cast(nullif(trim(`{c}`), '') AS {t})") for c, t in types.items()}
    ok = F.lit(True)
    for c in required:
        ok = ok & cast[c].isNotNull()
    return rows.where(ok).withColumns(cast), rows.where(~ok)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (ascending, not gapless) and line of text files."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def obj_mesh(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OBJ lines (file, line_no, line). Vertices count from 0 within a file; polygons become fans; negative numbers count back."""
    parts = lines.withColumn("p", F.split(F.trim("line"), r"\s+"))
    order = W.partitionBy("file").orderBy("line_no")
    marked = parts.withColumn("seen", F.count_if(F.get("p", F.lit(0)) == "v").over(order.rowsBetween(W.unboundedPreceding, 0)))
    num = lambda k: F.get("p", F.lit(k)).cast("double")
    vertices = marked.where(F.get("p", F.lit(0)) == "v").select("file", (F.col("seen") - 1).alias("v"), num(1).alias("x"), num(2).alias("y"), num(3).alias("z"))
    corner = lambda t: F.split(t, "/").getItem(0).cast("long")
    whole = F.transform(F.slice("p", 2, 1_000_000), lambda t: F.when(corner(t) < 0, F.col("seen") + corner(t)).otherwise(corner(t) - 1))
    faces = marked.where((F.get("p", F.lit(0)) == "f") & (F.size("p") >= 4)).select("file", "line_no", whole.alias("c"))
    fan = faces.select("file", "line_no", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))
    return vertices, fan.select("file", "line_no", "k", F.get("c", F.lit(0)).alias("a"), F.get("c", F.col("k")).alias("b"), F.get("c", F.col("k") + 1).alias("d"))


def dxf_entities(lines: DataFrame, kinds: tuple[str, ...] = ("LWPOLYLINE", "ARC", "CIRCLE", "LINE", "TEXT")) -> DataFrame:
    """file, entity, kind and its (code, value) tags in order, of the kinds asked for. lines: pairs of a code line and a value line."""
    order = W.partitionBy("file").orderBy("line_no")
    paired = lines.withColumns({"i": F.row_number().over(order), "value": F.trim(F.lead("line").over(order))}).where("i % 2 = 1").withColumn("code", F.expr("try_cast(trim(line) AS int)"))
    marked = paired.withColumn("entity", F.count_if(F.col("code") == 0).over(order.rowsBetween(W.unboundedPreceding, 0)))
    tags = F.transform(F.sort_array(F.collect_list(F.struct("i", "code", "value"))), lambda t: F.struct(t["code"].alias("code"), t["value"].alias("value")))
    whole = marked.groupBy("file", "entity").agg(tags.alias("tags"))
    return whole.withColumn("kind", F.get("tags", F.lit(0))["value"]).where(F.col("kind").isin(*kinds) & (F.get("tags", F.lit(0))["code"] == 0))


def manifest(lines: DataFrame) -> DataFrame:
    """name and digest of lines 'digest  name'."""
    p = F.split(F.trim("line"), r"\s+", 2)
    return lines.where(F.size(p) == 2).select(F.get(p, F.lit(1)).alias("name"), F.get(p, F.lit(0)).alias("digest"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """page (from the last number in the file's name) and text of a folder of page files."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    return raw.select(F.expr("try_cast(regexp_extract(file, '([0-9]+)[^0-9/]*$', 1) AS int)").alias("page"), F.col("value").alias("text"))


def pdf_streams(files: DataFrame) -> DataFrame:
    """path, stream and its bytes, inflated where it is deflated, of PDF files read as binaryFile. One file is one row, as in that source."""
    mark = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = []
                for m in mark.finditer(content or b""):
                    try:
                        found.append(zlib.decompress(m[1]))
                    except zlib.error:
                        found.append(m[1])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.binary())], ["path", "stream", "content"])

    return files.select("path", "content").mapInArrow(carve, "path string, stream int, content binary")


def jpeg_spans(streams: DataFrame) -> DataFrame:
    """Streams that are JPEG images, by their first bytes, with their size."""
    return streams.where(F.substring("content", 1, 2) == F.lit(bytearray(b"\xff\xd8"))).select("path", "stream", F.length("content").alias("n_bytes"))


def unicode_map(lines: DataFrame) -> DataFrame:
    """code and char of 'bfchar' lines '<hex> <hex>' of a font map."""
    pair = r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>"
    return lines.where(F.col("line").rlike(pair)).select(F.conv(F.regexp_extract("line", pair, 1), 16, 10).cast("int").alias("code"), F.char(F.conv(F.regexp_extract("line", pair, 2), 16, 10).cast("int")).alias("char"))
