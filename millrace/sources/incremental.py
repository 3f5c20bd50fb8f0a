"""Incremental reads with a stored watermark."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def above_watermark(df: DataFrame, column: str, last, *, initial=None, look_back: timedelta | float | None = None) -> DataFrame:
    """Rows newer than the last watermark, reaching back by ``look_back`` for late arrivals.
    The bound is a literal, so it is pushed into the scan."""
    start = last if last is not None else initial
    if start is None:
        return df
    if look_back is not None and last is not None:
        start = start - look_back
    kind = df.schema[column].dataType
    return df.filter(F.col(column) > F.lit(start).cast(kind))


def next_watermark(df: DataFrame, column: str, source: str) -> DataFrame:
    """A one-row table (source, watermark) to store after the load."""
    return df.agg(F.max(column).alias("watermark")).select(F.lit(source).alias("source"), F.col("watermark").cast("string").alias("watermark"))


def save_watermark(mark: DataFrame, path: str) -> None:
    """Marks are appended; the latest one wins, so a failed run leaves the last good one in place."""
    mark.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def load_watermark(spark: SparkSession, path: str, source: str, *, kind: str = "string", initial=None):
    """The last mark as a value of type ``kind`` (that of the column); ``initial`` on the first run, when nothing is stored yet."""
    try:
        marks = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return initial
    row = marks.filter(F.col("source") == source).agg(F.max_by("watermark", "saved_at").cast(kind).alias("w")).first()
    return initial if row["w"] is None else row["w"]


def partitions_since(df: DataFrame, partition: str, last, known: Sequence | None = None) -> DataFrame:
    """Whole partitions not loaded yet: those after ``last``, or not among ``known``."""
    return df.filter(~F.col(partition).isin(list(known))) if known is not None else df.filter(F.col(partition) > F.lit(last))
