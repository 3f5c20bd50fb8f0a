"""Catalogue tables and table formats. Delta and Iceberg need their jars on the session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, name: str, partition_filter: str | None = None) -> DataFrame:
    """The filter names partition columns, so only the matching folders are listed and read."""
    df = spark.table(name)
    return df.filter(F.expr(partition_filter)) if partition_filter else df


def delta_options(*, version: int | None = None, timestamp: str | None = None, change_feed: bool = False,
                  starting_version: int | None = None, starting_timestamp: str | None = None) -> dict[str, str]:
    if version is not None and timestamp is not None:
        raise ValueError("give a version or a timestamp, not both")
    out = {"versionAsOf": version, "timestampAsOf": timestamp}
    if change_feed:
        if starting_version is None and starting_timestamp is None:
            raise ValueError("a change feed needs a starting version or timestamp")
        out |= {"readChangeFeed": "true", "startingVersion": starting_version, "startingTimestamp": starting_timestamp}
    return {k: str(v) for k, v in out.items() if v is not None}


def read_delta(spark: SparkSession, path: str, options: Mapping[str, str] | None = None, **kw) -> DataFrame:
    return spark.read.format("delta").options(**delta_options(**kw), **(options or {})).load(path)


def iceberg_options(*, snapshot_id: int | None = None, as_of_timestamp: int | None = None) -> dict[str, str]:
    if snapshot_id is not None and as_of_timestamp is not None:
        raise ValueError("give a snapshot or a timestamp, not both")
    out = {"snapshot-id": snapshot_id, "as-of-timestamp": as_of_timestamp}
    return {k: str(v) for k, v in out.items() if v is not None}


def read_iceberg(spark: SparkSession, table: str, *, changes: bool = False, **kw) -> DataFrame:
    """``changes`` reads the table's row changes instead of its rows."""
    reader = spark.read.options(**iceberg_options(**kw))
    return reader.format("iceberg").load(f"{table}.changes") if changes else reader.table(table)


def read_connector(spark: SparkSession, format: str, options: Mapping[str, object]) -> DataFrame:
    """Any other connector on the classpath, such as mongodb or cassandra."""
    return spark.read.format(format).options(**{k: str(v) for k, v in options.items()}).load()
