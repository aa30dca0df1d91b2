"""Registries that grow as rows arrive, and tallies over windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _earlier(spark: SparkSession, path: str, schema, batch: int) -> DataFrame:
    """What batches before this one have added."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).where(F.col("batch") < batch).drop("batch")


def grow_registry(arriving: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Adds the first arriving row of each key that the registry lacks; rows there are never changed.

    A batch is a folder of its own, written whole, so a batch that is run again replaces itself.
    """

    def add(rows: DataFrame, batch: int) -> None:
        known = _earlier(rows.sparkSession, path, rows.schema, batch).select(*key)
        fresh = rows.join(known, key, "left_anti").withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_tally(events: DataFrame, time: str, column: str, width: str, late: str) -> DataFrame:
    """Counts of a column's values by window of time, final once events are later than the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), column).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), column, "n")
