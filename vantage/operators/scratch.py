"""Tables written between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset, one of our own if all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vantage-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out by key, never sent whole to all executors: Spark takes a table to be as large as its file, however many rows come from each of the file's, and a file of few megabytes can hold millions."""
    return df.hint("merge")
