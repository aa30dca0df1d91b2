"""SparkSession factory used by the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session: UTC, ANSI on, AQE on, no UI."""
    return (
        SparkSession.builder.master(master)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str):
    """One of the driver tables, dealt over tasks by key: a small file is one task's, however many rows come from each of its own."""
    return table(spark, sf_dir, name).repartition(key)
