"""Partitioning and persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from millrace.operators.ordering import sort_columns
from millrace.operators.sizing import row_hash

LEVELS = {
    "MEMORY_ONLY": StorageLevel.MEMORY_ONLY, "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK,
    "DISK_ONLY": StorageLevel.DISK_ONLY, "MEMORY_ONLY_2": StorageLevel.MEMORY_ONLY_2,
    "MEMORY_AND_DISK_2": StorageLevel.MEMORY_AND_DISK_2, "OFF_HEAP": StorageLevel.OFF_HEAP,
    # PySpark always stores serialised rows, so the _SER spellings mean the plain levels.
    "MEMORY_ONLY_SER": StorageLevel.MEMORY_ONLY, "MEMORY_AND_DISK_SER": StorageLevel.MEMORY_AND_DISK,
}
MAX_PARTITION_ROWS = 1_000_000


def _sizes(df: DataFrame, n: int | None, max_rows: int | None) -> list[int]:
    """``n``, or as many as leave about ``max_rows`` rows to a partition; file footers count a stored table. One stays one."""
    if not n or n == 1 or not max_rows:
        return [n] if n else []
    return [max(n, -(-df.count() // max_rows))]


def repartition(df: DataFrame, strategy: str = "hash", *, columns: Sequence[str] = (), n: int | None = None, salt: int = 0, max_rows: int | None = MAX_PARTITION_ROWS) -> DataFrame:
    """hash | range | round_robin | coalesce | none.

    ``n`` partitions, and more where a table is too long for so few: a partition is a task, which should
    not grow with the table. ``max_rows=None`` takes ``n`` as it stands; ``coalesce`` always does.

    Round robin uses a row hash, which stays put when a task is re-run. ``salt`` > 1 with hash
    spreads each key over that many partitions, for keys too large for one. Nothing is squeezed
    into a single partition unless ``n=1`` is asked for.
    """
    if strategy == "none":
        return df
    if strategy == "coalesce":
        return df.coalesce(n) if n else df
    size = _sizes(df, n, max_rows)
    if strategy == "range":
        return df.repartitionByRange(*size, *sort_columns(columns))
    if strategy == "round_robin" or not columns:
        return df.repartition(*size, row_hash(df))
    extra = [F.pmod(row_hash(df, columns), F.lit(salt))] if salt > 1 else []
    return df.repartition(*size, *[F.col(c) for c in columns], *extra)


def clustered(df: DataFrame, columns: Sequence[str], n: int | None = None, max_rows: int | None = MAX_PARTITION_ROWS) -> DataFrame:
    """Range-partition and sort by ``columns``: tight min/max statistics per file for later pruning. ``n`` and ``max_rows`` as in ``repartition``."""
    return df.repartitionByRange(*_sizes(df, n, max_rows), *columns).sortWithinPartitions(*columns)


def _rank(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending ``bounds`` are below ``value``: log2(len) comparisons."""
    if not bounds:
        return F.lit(0)
    at = F.lit(0)
    known = F.array(*[F.lit(float(b)) for b in bounds])
    steps = F.array(*[F.lit(1 << e) for e in reversed(range(len(bounds).bit_length()))])
    fits = lambda place: (place <= len(bounds)) & (F.get(known, F.least(place, F.lit(len(bounds))) - 1) < value)
    return F.aggregate(steps, at, lambda place, step: place + F.when(fits(place + step), step).otherwise(0))


def z_value(df: DataFrame, columns: Sequence[str], bits: int = 8, accuracy: int = 10_000) -> Column:
    """One key for several columns: each column's quantile rank of ``bits`` bits, the bits of all columns interleaved.

    The ranks come from one pass of quantile sketches, whose size does not grow with the table; NULL has rank 0.
    """
    if bits * len(columns) > 63:
        raise ValueError("bits * columns must not exceed 63")
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    number = {c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if isinstance(df.schema[c].dataType, (DateType, TimestampType, TimestampNTZType)) else F.col(c).cast("double") for c in columns}
    cuts = df.agg(*[F.percentile_approx(number[c], shares, accuracy).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        bounds = sorted(cuts[f"c{i}"] or [])
        rank = F.when(number[c].isNotNull(), _rank(number[c], bounds)).otherwise(F.lit(0)).cast("bigint")
        for b in range(bits):
            bit = F.shiftright(rank, b).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return key


def z_ordered(df: DataFrame, columns: Sequence[str], n: int | None = None, bits: int = 8, max_rows: int | None = MAX_PARTITION_ROWS) -> DataFrame:
    """Range-partition and sort by the interleaved ranks of ``columns``, so that ranges of any of them touch few files.

    A value with many rows takes the rank of its first quantile, so that few distinct values still use all bits.
    ``n`` and ``max_rows`` as in ``repartition``.
    """
    keyed = df.withColumn("__z", z_value(df, columns, bits))
    return keyed.repartitionByRange(*_sizes(df, n, max_rows), "__z").sortWithinPartitions("__z").drop("__z")


def persist(df: DataFrame, level: str = "MEMORY_AND_DISK", eager: bool = False) -> DataFrame:
    kept = df.persist(LEVELS[level.upper()])
    if eager:
        kept.count()
    return kept


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def skew_report(df: DataFrame, keys: Sequence[str], factor: float = 3.0, against: str = "mean") -> DataFrame:
    """Keys with more than ``factor`` times the mean or median rows per key. A few huge keys raise the mean and hide
    each other; the median, taken over counts of counts, they leave where it is."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    if against == "mean":
        usual = counts.agg(F.avg("rows")).scalar()
    elif against == "median":
        usual = counts.groupBy("rows").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("rows", 0.5, F.col("n"))).scalar()
    else:
        raise ValueError(f"against must be mean or median, not {against!r}")
    return counts.withColumn(f"times_{against}", F.col("rows") / usual).filter(F.col(f"times_{against}") > factor)
