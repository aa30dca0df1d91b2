from __future__ import annotations

from vantage.streaming.registry import grow_registry, windowed_tally


def test_registry_grows_by_first_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v string"
    spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], schema).coalesce(1).write.parquet(src)
    for rows in ([], [(2, "new"), (3, "d")]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        grow_registry(spark.readStream.schema(schema).parquet(src), out, ["k"], ["v"], str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 03:00:00", "y")]
    spark.createDataFrame(rows, "t string, kind string").selectExpr("cast(t AS timestamp) AS t", "kind").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("t timestamp, kind string").parquet(src)
    query = windowed_tally(stream, "t", "kind", "10 minutes", "30 minutes").writeStream.format("memory").queryName("tally").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert [(r["kind"], r["n"]) for r in spark.table("tally").collect()] == [("x", 2)]
