"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what
it returns is written as Parquet and read again as the next one's docs. An empty table
goes through all stages as an empty table, and every stage but the last keeps all columns
of documents, others too, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import langid, mixing, ngram_join, packing, secrets
from vantage.llm.shared import documents, keep, small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; lang becomes the predicted one.

    Null and empty texts, and those without a letter, go. Very long texts are labelled in
    parts, all of which count; ties between languages go to the first by name; repeated
    rows and null ids stay as rows of their own.
    """
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the first in the order of the files.

    Null and empty texts are similar to nothing and stay; of repeated rows one stays; ties
    don't occur, as rows are numbered; very long texts are compared as whole sets; ids
    play no part, so null and repeated ones don't matter.
    """
    small_batches(spark)
    return ngram_join.first_of_groups(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked.

    Null texts stay null and empty ones empty; spans that overlap are one mask; very long
    texts are scanned whole; repeated rows are masked alike.
    """
    return secrets.redact(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and count for nothing, whether they are taken or
    not; a null source is one of its own, the last; of equal ranks the smaller id goes
    first, and rows that repeat an id within a source go together; a very long text that
    would pass its source's target is taken if that comes nearer to it.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of one length.

    Null and empty texts are one closing id; very long texts are cut into full windows and
    a rest; of equal lengths the smaller id goes first; repeated rows and null ids are
    documents of their own; only the pieces' columns are returned.
    """
    small_batches(spark)
    return packing.pack(keep(packing.pieces(docs, packing.default_path()), "pieces"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Language models and token ids can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
