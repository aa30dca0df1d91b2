"""Sinks: CSV, layered and sliced Parquet, PLY and OBJ text, GeoJSON features, Markdown, merged registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_layers(df: DataFrame, path: str, layer: str) -> None:
    """One folder for each value of a column: slices by height, layers by kind or class."""
    df.write.mode("overwrite").partitionBy(layer).parquet(path)


def features(df: DataFrame, x: str, y: str) -> DataFrame:
    """One GeoJSON point feature a row, as text; other columns are its properties."""
    rest = [c for c in df.columns if c not in (x, y)]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def ply_points(points: DataFrame) -> DataFrame:
    """Lines of an ASCII PLY of points (x, y, z[, count]), with their order: write them sorted by it."""
    counted = "count" in points.columns
    head = ["ply", "format ascii 1.0", None, "property double x", "property double y", "property double z", *(["property int count"] if counted else []), "end_header"]
    spark = points.sparkSession
    total = points.agg(F.count("*").alias("n"))
    lines = spark.createDataFrame([(k, h) for k, h in enumerate(head)], "k long, value string").crossJoin(total).select("k", F.coalesce("value", F.concat(F.lit("element vertex "), F.col("n").cast("string"))).alias("value"))
    body = F.format_string("%.3f %.3f %.3f" + " %d" * counted, "x", "y", "z", *(["count"] if counted else []))
    return lines.select(F.lit(0).alias("part"), "k", "value").unionByName(points.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("k"), body.alias("value")))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines of an OBJ of vertices (v, x, y, z) and triangles (a, b, d), which count from 0, with their order."""
    v = vertices.select(F.lit(0).alias("part"), F.col("v").cast("long").alias("k"), F.format_string("v %.4f %.4f %.4f", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("k"), F.concat_ws(" ", F.lit("f"), *((F.col(c) + 1).cast("string") for c in ("a", "b", "d"))).alias("value"))
    return v.unionByName(f)


def write_lines(lines: DataFrame, path: str) -> None:
    """Ordered lines (part, k, value) as text files whose names sort in order."""
    lines.repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


def markdown(df: DataFrame, most: int = 500) -> str:
    """A small result as a Markdown table; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    cell = lambda x: "" if x is None else str(x)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def merge_into(registry: DataFrame, incoming: DataFrame, key: list[str], order: list[str], path: str) -> None:
    """Writes the registry with the incoming rows whose key it lacks, sorted, to a new path; what is there is never changed."""
    fresh = incoming.join(registry.select(*key), key, "left_anti").withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
    registry.unionByName(fresh).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def digest(df: DataFrame) -> str:
    """A hash of a table that doesn't depend on the order of its rows: for golden comparisons."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(row).alias("s")).first()
    return f"{r['n']}-{r['s'] or 0}"


def ply_mesh(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines of an ASCII PLY of vertices (v, x, y, z) and triangles (a, b, d), which count from 0, with their order."""
    head = ["ply", "format ascii 1.0", "vertices", "property double x", "property double y", "property double z", "faces", "property list uchar int vertex_indices", "end_header"]
    counts = vertices.agg(F.count("*").alias("nv")).join(faces.agg(F.count("*").alias("nf")))
    lines = vertices.sparkSession.createDataFrame(list(enumerate(head)), "k long, value string").join(F.broadcast(counts))
    value = F.when(F.col("value") == "vertices", F.concat(F.lit("element vertex "), F.col("nv").cast("string"))).when(F.col("value") == "faces", F.concat(F.lit("element face "), F.col("nf").cast("string"))).otherwise(F.col("value"))
    v = vertices.select(F.lit(1).alias("part"), F.col("v").cast("long").alias("k"), F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(2).alias("part"), F.monotonically_increasing_id().alias("k"), F.concat_ws(" ", F.lit("3"), *(F.col(c).cast("string") for c in ("a", "b", "d"))).alias("value"))
    return lines.select(F.lit(0).alias("part"), "k", value.alias("value")).unionByName(v).unionByName(f)


def terrain_obj(dem: DataFrame, step: int) -> DataFrame:
    """Lines of an OBJ of every step-th cell of a grid (r, c, z), missing heights as the median; y runs against the rows."""
    from vantage.operators.raster import terrain_faces

    coarse = dem.where(f"r % {step} = 0 AND c % {step} = 0")
    facts = dem.agg(F.percentile_approx("z", 0.5).alias("m"), (F.floor(F.max("c") / step) + 1).alias("w"))
    v = coarse.join(F.broadcast(facts)).select((F.floor(F.col("r") / step) * F.col("w") + F.floor(F.col("c") / step)).alias("v"), F.col("c").cast("double").alias("x"), (-F.col("r")).cast("double").alias("y"), F.coalesce("z", "m").cast("double").alias("z"))
    return obj_lines(v, terrain_faces(dem, step))


def write_volume(cells: DataFrame, path: str, facts: dict) -> None:
    """A volume (r, c, l, ...) as Parquet by level, and beside it one line of JSON that says where it lies."""
    write_layers(cells, f"{path}/cells", "l")
    names = sorted(facts)
    cells.sparkSession.range(1).select(F.to_json(F.struct(*(F.lit(facts[n]).alias(n) for n in names))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/about")


def checkpoint(rows: DataFrame, path: str, mark: Column) -> None:
    """Rows with their configuration's mark, in a folder of their own: it counts once its _SUCCESS is there, so a broken write is never taken up."""
    rows.withColumn("fingerprint", mark).write.mode("errorifexists").parquet(path)


def report(sections: list[tuple[str, DataFrame]], most: int = 500) -> str:
    """Small results as one Markdown report, a heading and a table each."""
    return "\n\n".join(f"## {title}\n\n{markdown(df, most)}" for title, df in sections)
