"""Set operations over two or more inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _need_two(frames: Sequence[DataFrame]) -> None:
    if len(frames) < 2:
        raise ValueError("set operations need at least two inputs")


def union_all(*frames: DataFrame) -> DataFrame:
    """By position, duplicates kept."""
    _need_two(frames)
    return reduce(DataFrame.unionAll, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """By position; one distinct after all inputs are stacked, not one per step."""
    return union_all(*frames).distinct()


def union_by_name(*frames: DataFrame, allow_missing: bool = False, sources: Sequence[str] | None = None,
                  source_column: str = "source", fill: dict | None = None) -> DataFrame:
    """By name, duplicates kept. ``sources`` tags the rows of each input; ``fill`` replaces the
    NULLs of columns an input does not have (its own NULLs stay)."""
    _need_two(frames)
    if fill:
        frames = tuple(
            f.withColumns({c: F.lit(v) for c, v in fill.items() if c not in f.columns}) for f in frames
        )
    if sources:
        frames = tuple(f.withColumn(source_column, F.lit(s)) for f, s in zip(frames, sources))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def intersect(*frames: DataFrame, all: bool = False) -> DataFrame:
    _need_two(frames)
    return reduce(DataFrame.intersectAll if all else DataFrame.intersect, frames)


def except_(*frames: DataFrame, all: bool = False) -> DataFrame:
    """Rows of the first input found in none of the others, left to right."""
    _need_two(frames)
    return reduce(DataFrame.exceptAll if all else DataFrame.subtract, frames)


def right_only(left: DataFrame, right: DataFrame) -> DataFrame:
    return right.subtract(left)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on exactly one side: both inputs are tagged and grouped once, instead of two subtracts."""
    tagged = left.withColumn("__side", F.lit(1)).unionAll(right.withColumn("__side", F.lit(2)))
    sides = tagged.groupBy(*left.columns).agg(F.min("__side").alias("__a"), F.max("__side").alias("__b"))
    return sides.filter("__a = __b").select(*left.columns)
