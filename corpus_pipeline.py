"""Five stages from raw documents to token ids; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, pieces, repeats, simhash
from millrace.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a recognised language; null texts, texts without a letter and undecided ones go."""
    return language.accept(docs, language.learned(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents whose fingerprints of three-word shingles are linked at two bits or fewer."""
    return simhash.first_of_each(docs, shingle=simhash.SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document has; ``n_chars`` follows the text."""
    return repeats.without_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, up to an edit similarity of 0.8."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text that is left, and whether they decode to it."""
    return pieces.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: Fingerprints, CGK hashing and piece segmentation are beyond SQL: tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
