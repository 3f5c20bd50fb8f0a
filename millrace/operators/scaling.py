"""Buckets, scaling and imputation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregates import exact_percentiles, mode
from millrace.operators.windows import RUNNING_ROWS, WindowFn, window
from millrace.operators.ordering import as_sorts
from millrace.operators.sizing import join_back


def bucket_by_edges(df: DataFrame, column: str, edges: Sequence[float], alias: str) -> DataFrame:
    """0 below the first edge, 1 from it on, and so on."""
    steps = [F.when(F.col(column) >= e, 1).otherwise(0) for e in edges]
    return df.withColumn(alias, F.when(F.col(column).isNotNull(), reduce(lambda a, b: a + b, steps)))


def bucket_equal_width(df: DataFrame, column: str, bins: int, alias: str) -> DataFrame:
    """Bins 1 … n between the table's minimum and maximum (the maximum belongs to bin n)."""
    s = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    work = df.withColumn("__s", s)
    c, lo, hi = F.col(column), F.col("__s.lo"), F.col("__s.hi")
    position = F.floor(F.try_divide((c - lo) * bins, hi - lo)) + 1
    return work.withColumn(alias, F.when(c.isNotNull(), F.least(F.coalesce(position, F.lit(1)), F.lit(bins)))).drop("__s")


def bucket_equal_frequency(df: DataFrame, order_by, bins: int, alias: str, **kw) -> DataFrame:
    """Quantile bins by row count; give a unique tie-breaker in ``order_by`` for stable bins."""
    return window(df, [WindowFn("ntile", alias, n=bins)], order_by=order_by, **kw)


def scale(df: DataFrame, column: str, method: str, alias: str, group_by: Sequence[str] = ()) -> DataFrame:
    """minmax | zscore, over the table or per group. Statistics are aggregated, then joined."""
    aggs = [F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd")]
    if group_by:
        stats = df.groupBy(*group_by).agg(F.struct(*aggs).alias("__s"))
        work = join_back(df, stats, group_by)
    else:
        work = df.withColumn("__s", df.agg(F.struct(*aggs)).scalar())
    c = F.col(column)
    if method == "minmax":
        value = F.try_divide(c - F.col("__s.lo"), F.col("__s.hi") - F.col("__s.lo"))
    else:
        value = F.try_divide(c - F.col("__s.mean"), F.col("__s.sd"))
    return work.withColumn(alias, value).drop("__s")


def impute(df: DataFrame, column: str, method: str, *, group_by: Sequence[str] = (), value=None) -> DataFrame:
    """constant | mean | median | mode; the statistic ignores NULLs and fills only them."""
    if method == "constant":
        return df.withColumn(column, F.coalesce(column, F.lit(value)))
    if method == "mean":
        agg = F.avg(column).alias("__fill")
        stats = df.groupBy(*group_by).agg(agg) if group_by else df.agg(agg)
    elif method == "median":
        stats = exact_percentiles(df, group_by, column, {"__fill": 0.5})
    elif method == "mode":
        stats = mode(df, group_by, column, "__fill")
    else:
        raise ValueError(f"unknown method {method!r}")
    work = join_back(df, stats, group_by) if group_by else df.withColumn("__fill", stats.scalar())
    return work.withColumn(column, F.coalesce(F.col(column), F.col("__fill").cast(df.schema[column].dataType))).drop("__fill")


def fill_along(df: DataFrame, column: str, direction: str, *, partition_by: Sequence[str] = (), order_by, alias: str, **kw) -> DataFrame:
    """Carry the last known value forward, or the next one backward."""
    sorts = as_sorts(order_by)
    if direction == "backward":
        sorts = [s.reversed() for s in sorts]
    return window(df, [WindowFn("last", alias, column)], partition_by=partition_by, order_by=sorts, frame=RUNNING_ROWS, **kw)


def interpolate(df: DataFrame, column: str, position: str, *, partition_by: Sequence[str] = (), order_by, alias: str, **kw) -> DataFrame:
    """Linear between the nearest known neighbours along ``position`` (numeric); open ends stay NULL."""
    known = df.withColumn("__at", F.when(F.col(column).isNotNull(), F.struct(F.col(position).cast("double").alias("x"), F.col(column).cast("double").alias("y"))))
    both = fill_along(known, "__at", "forward", partition_by=partition_by, order_by=order_by, alias="__p", **kw)
    both = fill_along(both, "__at", "backward", partition_by=partition_by, order_by=order_by, alias="__q", **kw)
    x, p, q = F.col(position).cast("double"), F.col("__p"), F.col("__q")
    line = p["y"] + (q["y"] - p["y"]) * F.try_divide(x - p["x"], q["x"] - p["x"])
    return both.withColumn(alias, F.coalesce(F.col(column).cast("double"), line, F.when(p["x"] == q["x"], p["y"]))).drop("__at", "__p", "__q")
