"""Registered queries: each reads the given tables whole and, where SQL can say it, carries its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._schemas = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._schemas:       # footers are read once, however often a query names the table
            self._schemas[name] = self.spark.read.parquet(self.path(name)).schema
        return self.spark.read.schema(self._schemas[name]).parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(*ids: str, sql: str | None = None):
    """Register a query under its function name; ``ids`` are the inventory entries it covers."""
    def keep(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} is registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn
    return keep


# ------------------------------------------------------------------ shared expressions


def money(c: str | Column) -> Column:
    """Two exact decimals, so that sums do not depend on the order of addition."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(15,2)")


def total(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double")


def day(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date").cast("string")


def sql_total(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(15,2))) AS DOUBLE)"


def sql_day(c: str) -> str:
    return f"CAST(CAST({c} AS DATE) AS VARCHAR)"
