"""A training corpus from raw documents: five stages, each written before the next reads it.

In every stage rows that repeat stay apart unless they are near duplicates,
null and empty texts are documents like any other (not toxic, no copies, no
overlap, no secrets, no tokens), very long texts are read whole, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import bpe, decontaminate, near_dup, secret_scan, toxicity
from wardlight.llm.queries import vocabulary_path
from wardlight.session import work_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go, each by its own text; a null or repeated id changes nothing."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return near_dup.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item of four words or more go.

    Rows that share an id go together; those with a null id stay unless one of them overlaps.
    """
    return decontaminate.without_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars is that of the text that stays. No document goes."""
    return secret_scan.without_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, one row for each row; none for a null or empty text."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

# Groups of a similarity join and a tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
