"""Grouped and global aggregation, pivots, exact percentiles, latest row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import sort_columns
from millrace.operators.windows import RUNNING_RANGE, WindowFn, window


@dataclass(frozen=True)
class Agg:
    """``function(column) AS alias``. ``order_by`` makes first/last deterministic;
    ``args`` passes percentages, separators, accuracies and the like."""

    function: str
    column: str = "*"
    alias: str | None = None
    distinct: bool = False
    order_by: str | None = None
    args: tuple = ()

    def to_column(self) -> Column:
        name, c = self.function, F.col(self.column) if self.column != "*" else None
        lowered = name.lower()
        if lowered in ("count", "countdistinct", "count_distinct"):
            if lowered != "count" or self.distinct:
                out = F.count_distinct(c) if c is not None else F.count_distinct(F.struct("*"))
            else:
                out = F.count(F.lit(1)) if c is None else F.count(c)
        elif lowered == "sum":
            out = F.sum_distinct(c) if self.distinct else F.sum(c)
        elif lowered == "avg" and self.distinct:
            out = F.try_divide(F.sum_distinct(c), F.count_distinct(c))
        elif lowered in ("first", "last"):
            if self.order_by:
                by = F.when(c.isNotNull(), F.col(self.order_by))
                out = (F.min_by if lowered == "first" else F.max_by)(c, by)
            else:
                out = getattr(F, lowered)(c, True)
        elif lowered in ("collect_list", "array_agg"):
            out = F.array_sort(F.collect_set(c) if self.distinct else F.collect_list(c))
        elif lowered == "collect_set":
            out = F.array_sort(F.collect_set(c))
        elif lowered in ("string_agg", "listagg"):
            out = F.array_join(F.array_sort(F.collect_set(c) if self.distinct else F.collect_list(c)), *(self.args or (",",)))
        else:
            out = getattr(F, name)(c, *self.args)
        return out.alias(self.alias or f"{lowered}_{self.column}".replace("*", "all"))


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[Agg], having: str | Column | None = None) -> DataFrame:
    """Spark combines on the map side, so skewed groups shuffle one partial row per task.
    Empty ``group_by`` aggregates the whole table. ``having`` sees the aliases."""
    columns = [a.to_column() for a in aggregations]
    out = df.groupBy(*group_by).agg(*columns) if group_by else df.agg(*columns)
    if having is not None:
        out = out.filter(F.expr(having) if isinstance(having, str) else having)
    return out


def rollup(df, group_by, aggregations) -> DataFrame:
    return df.rollup(*group_by).agg(*[a.to_column() for a in aggregations])


def cube(df, group_by, aggregations) -> DataFrame:
    return df.cube(*group_by).agg(*[a.to_column() for a in aggregations])


def grouping_sets(df, sets: Sequence[Sequence[str]], aggregations) -> DataFrame:
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*[a.to_column() for a in aggregations])


# ------------------------------------------------------------------ pivot and unpivot


def pivot(df: DataFrame, group_by: Sequence[str], column: str, aggregations: Sequence[Agg], values: Sequence | None = None, *,
          fill=None, max_columns: int = 1000, rename: str | None = None) -> DataFrame:
    """Give ``values`` where they are known: it saves the extra job that lists them.
    ``rename`` is a pattern such as "n_{value}", or "{agg}_of_{value}" with the aggregates' own names;
    with several aggregates it must tell them apart."""
    if values is None:
        found = df.select(column).distinct().orderBy(column).limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"more than {max_columns} pivot values in {column}")
        values = [r[0] for r in found]
    out = df.groupBy(*group_by).pivot(column, list(values)).agg(*[a.to_column() for a in aggregations])
    made = [c for c in out.columns if c not in set(group_by)]
    if fill is not None:
        out = out.fillna(fill, subset=made)
    if rename:
        # Made columns come value by value, each with the aggregates in their order.
        names = [rename.format(value=v, agg=a.alias) for v in values for a in aggregations]
        if len({*names, *group_by}) < len(names) + len(set(group_by)):
            raise ValueError(f"{rename!r} gives two columns one name")
        out = out.toDF(*out.columns[:len(group_by)], *names)
    return out


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], variable: str = "variable", value: str = "value", *,
            drop_nulls: bool = False) -> DataFrame:
    out = df.unpivot(list(ids), list(columns), variable, value)
    return out.filter(F.col(value).isNotNull()) if drop_nulls else out


def unpivot_groups(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Sequence[str]], variable: str, values: Sequence[str]) -> DataFrame:
    """Several value columns at once: ``groups`` maps a label to the columns that fill ``values``."""
    items = F.array(*[
        F.struct(F.lit(label).alias(variable), *[F.col(c).alias(v) for c, v in zip(cols, values)])
        for label, cols in groups.items()
    ])
    return df.select(*ids, F.explode(items).alias("__x")).select(*ids, "__x.*")


# ------------------------------------------------------------------ order statistics


def exact_percentiles(df: DataFrame, group_by: Sequence[str], column: str, points: Mapping[str, float], **kw) -> DataFrame:
    """Exact interpolated percentiles of groups of any size.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here equal values
    are counted first, a running count (cut along the order for hot groups) gives their ranks, and
    each percentile is read off with conditional minima. NULLs are ignored.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(*group_by, column).agg(F.count(F.lit(1)).alias("__n"))
    # Distinct values are at most as many as rows, so the rows (a pruned scan) are counted first.
    ranked = window(counted, [WindowFn("sum", "__upto", "__n")], partition_by=group_by, order_by=column, frame=RUNNING_RANGE, counts_from=df, **kw)
    totals = counted.groupBy(*group_by).agg(F.sum("__n").alias("__total")) if group_by else None
    if group_by:
        side = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group_by)], "__total")
        cond = F.lit(True)
        for i, g in enumerate(group_by):
            cond = cond & ranked[g].eqNullSafe(F.col(f"__g{i}"))
        placed = ranked.join(side, cond)
    else:
        placed = ranked.withColumn("__total", counted.agg(F.sum("__n")).scalar())
    aggs, out = [], []
    for i, (alias, p) in enumerate(points.items()):
        position = (F.col("__total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        aggs += [F.min(F.when(F.col("__upto") > low, F.col(column))).alias(f"__lo{i}"),
                 F.min(F.when(F.col("__upto") > high, F.col(column))).alias(f"__hi{i}"),
                 F.first(position - low).alias(f"__w{i}")]
        out.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__w{i}")).alias(alias))
    grouped = placed.groupBy(*group_by).agg(*aggs) if group_by else placed.agg(*aggs)
    return grouped.select(*group_by, *out)


def mode(df: DataFrame, group_by: Sequence[str], column: str, alias: str = "mode") -> DataFrame:
    """Most frequent value; the smallest one on ties. Counts combine before the shuffle."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*group_by, column).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min_by(F.col(column), F.struct(-F.col("__n"), F.col(column))).alias(alias)
    return counted.groupBy(*group_by).agg(best) if group_by else counted.agg(best)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row with the greatest ``order_by`` for each key, as an aggregate (no sort of whole groups)."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_by)).alias("__row"))
    return picked.select(*keys, "__row.*")


def run_report(df: DataFrame, *, group_by: Sequence[str] = (), status: str, success: str, running: str, failed: str,
               duration: str, sla_limit: float, volume: str, period: str | Column | None = None) -> DataFrame:
    """KPI report over a run log in one pass of conditional aggregates."""
    if period is not None:
        df = df.filter(F.expr(period) if isinstance(period, str) else period)
    s = F.col(status)
    aggs = [
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(s == running).alias("running_runs"),
        F.count_if(s == failed).alias("failed_runs"),
        (F.try_divide(F.count_if(s == success) * F.lit(100.0), F.count(F.lit(1)))).alias("success_rate_pct"),
        F.try_divide(F.sum(F.when(s == success, F.col(duration))).cast("double"), F.count(F.when(s == success, F.col(duration)))).alias("avg_success_duration"),
        F.count_if(F.col(duration) > sla_limit).alias("sla_breaches"),
        F.sum(volume).alias("volume"),
    ]
    return df.groupBy(*group_by).agg(*aggs) if group_by else df.agg(*aggs)


def spearman(df: DataFrame, x: str, y: str, alias: str = "spearman", **kw) -> DataFrame:
    """Rank correlation with averaged ties. Ranks are computed on the distinct values of each
    column (with their counts), never by sorting all rows in one task."""
    clean = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)

    def ranks(c, out):
        counted = clean.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        upto = window(counted, [WindowFn("sum", "upto", "n")], order_by=c, frame=RUNNING_RANGE, counts_from=df, **kw)
        return upto.select(F.col(c).alias(f"{out}_v"), (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias(out))

    # Each (x, y) pair once, weighted by its count: a repeated value does not become a hot join key.
    pairs = clean.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    r = pairs.join(ranks(x, "rx"), F.col(x) == F.col("rx_v")).join(ranks(y, "ry"), F.col(y) == F.col("ry_v"))
    w = F.col("w")
    sums = r.agg(F.sum(w).alias("n"), F.sum(w * F.col("rx")).alias("sx"), F.sum(w * F.col("ry")).alias("sy"),
                 F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"),
                 F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(w * F.col("ry") * F.col("ry")).alias("syy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    return sums.select(F.try_divide(cov, F.sqrt(vx * vy)).alias(alias))


def top_k(df: DataFrame, order_by, k: int) -> DataFrame:
    return df.orderBy(*sort_columns(order_by)).limit(k)
