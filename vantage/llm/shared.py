"""What the operators share: scratch tables, the word rule, and the split of labelled rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where unset, one of our own if all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vantage-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and it outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/vantage-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Batches to Python are held to BATCH_ROWS rows and about BATCH_BYTES, so that one of long texts fits a worker. All queries of this subpackage ask for the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def crc_rest(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a number's decimal digits; 3988292384 is the checksum's polynomial."""
    step = "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))"
    digits = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {step})))"


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters a name holds."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def bounded_labels(labels: DataFrame, column: str, positive: int, negative: int) -> DataFrame:
    """doc_id, y and rate, the share of its kind that is taken, of at most so many labelled ids of each kind, by a hash of the id; an id is 1 if any of its rows says so."""
    ids = labels.select("doc_id", F.col(column).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    own = []
    for y, most in ((1, positive), (0, negative)):
        total = counts.get(y, 0)
        near = ids.where(f"y = {y}").where(part < min(1.0, 1.1 * most / max(1, total)))
        rate = min(most, near.count()) / total if total > most else 1.0
        own.append(near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("rate", F.lit(rate)))
    return own[0].unionByName(own[1])
