"""Row and column operators: filter, project, derive, sort, dedup, sample, split, conform."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.conditions import as_condition, case_when, operand
from millrace.operators.ordering import as_sorts, sort_columns
from millrace.operators.sizing import row_hash

# ------------------------------------------------------------------ filter and split


def filter_rows(df: DataFrame, condition, mode: str = "INCLUDE") -> DataFrame:
    """INCLUDE keeps rows where the condition holds, EXCLUDE those where it is false.
    Rows where it is NULL are in neither; ``filter_split`` keeps them."""
    cond = as_condition(condition)
    return df.filter(~cond if mode.upper() == "EXCLUDE" else cond)


def filter_split(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected). NULL counts as rejected, so the two always add up to the input."""
    passed = F.coalesce(as_condition(condition), F.lit(False))
    return df.filter(passed), df.filter(~passed)


def null_split(df: DataFrame, columns: Sequence[str], how: str = "any") -> tuple[DataFrame, DataFrame]:
    """(complete rows, rows with missing values)."""
    count = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    missing = count > 0 if how == "any" else count == len(columns)
    return df.filter(~missing), df.filter(missing)


def route(df: DataFrame, routes: Sequence[tuple[str, object]], default: str = "default", alias: str = "route") -> DataFrame:
    """Label each row with the first route whose condition holds. One pass; filter on the label
    (or write partitioned by it) instead of scanning once per output."""
    return df.withColumn(alias, case_when([(cond, F.lit(name)) for name, cond in routes], F.lit(default)))


def route_all(df: DataFrame, routes: Sequence[tuple[str, object]], alias: str = "route") -> DataFrame:
    """Like ``route``, but a row appears once for every route it satisfies."""
    hits = F.array(*[F.when(F.coalesce(as_condition(cond), F.lit(False)), F.lit(name)) for name, cond in routes])
    return df.withColumn(alias, F.explode(F.filter(hits, lambda x: x.isNotNull())))


# ------------------------------------------------------------------ columns


def select_columns(df: DataFrame, columns: Sequence[str] = (), expressions: Mapping[str, object] | None = None) -> DataFrame:
    derived = [operand_expr(e).alias(a) for a, e in (expressions or {}).items()]
    return df.select(*columns, *derived)


def operand_expr(e) -> Column:
    return e if isinstance(e, Column) else F.expr(str(e))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def cast(df: DataFrame, types: Mapping[str, str], tolerant: bool = False) -> DataFrame:
    """Cast columns in one projection. ``tolerant`` yields NULL for values that do not convert."""
    return df.withColumns({c: F.col(c).try_cast(t) if tolerant else F.col(c).cast(t) for c, t in types.items()})


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def derive(df: DataFrame, entries: Sequence[tuple]) -> DataFrame:
    """Ordered ``(name, expression[, type])``; each entry sees the ones before it."""
    for name, expression, *kind in entries:
        value = operand_expr(expression)
        df = df.withColumn(name, value.cast(kind[0]) if kind and kind[0] else value)
    return df


def rename_pattern(df: DataFrame, *, prefix: str = "", suffix: str = "", regex: str | None = None,
                   replacement: str = "", style: str | None = None, only: str | None = None) -> DataFrame:
    """Rename all columns (or those matching ``only``) by prefix, suffix, regex or case style."""
    def new(name: str) -> str:
        if only and not re.search(only, name):
            return name
        if regex:
            name = re.sub(regex, replacement, name)
        if style == "snake":
            name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
        elif style == "camel":
            head, *rest = name.split("_")
            name = head.lower() + "".join(w[:1].upper() + w[1:].lower() for w in rest)
        return f"{prefix}{name}{suffix}"
    return df.toDF(*[new(c) for c in df.columns])


def select_pattern(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def reorder(df: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    middle = [c for c in df.columns if c not in set(first) | set(last)]
    return df.select(*first, *middle, *last)


# ------------------------------------------------------------------ sort, limit, dedup, missing values


def sort(df: DataFrame, order_by) -> DataFrame:
    return df.orderBy(*sort_columns(order_by))


def sort_within_partitions(df: DataFrame, order_by, repartition_by: Sequence[str] = ()) -> DataFrame:
    df = df.repartition(*repartition_by) if repartition_by else df
    return df.sortWithinPartitions(*sort_columns(order_by))


def limit(df: DataFrame, n: int, order_by=None) -> DataFrame:
    """With an order this is a top-k: each task keeps its own k rows, only those are merged."""
    return (df.orderBy(*sort_columns(order_by)) if order_by is not None else df).limit(n)


def dedup(df: DataFrame, keys: Sequence[str] = (), *, keep: str = "any", order_by=None, count_alias: str | None = None) -> DataFrame:
    """One row per key. ``keep`` = any | first | last (by ``order_by``).

    A key holding a third of the table stays cheap: for first and last Spark keeps one row per key
    and map task before the shuffle (window group limit), and counting copies is an aggregate with
    map-side combine.
    """
    keys = list(keys) or df.columns
    if keep == "any" and count_alias is None:
        return df.dropDuplicates(keys)
    sorts = as_sorts(order_by) if order_by is not None else []
    if keep == "last":
        sorts = [s.reversed() for s in sorts]
    if count_alias is None:
        spec = W.partitionBy(*keys).orderBy(*sort_columns(sorts))
        return df.withColumn("__rn", F.row_number().over(spec)).filter("__rn = 1").drop("__rn")
    counted = F.count(F.lit(1)).alias(count_alias)
    if not sorts:
        rest = [c for c in df.columns if c not in keys]
        out = df.groupBy(*keys).agg(counted, *([F.max(F.struct(*rest)).alias("__row")] if rest else []))
        return out.select(*[F.col(f"__row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns], count_alias)
    # One row per key on either side; the same row as without a count, whatever directions and NULL rules.
    picked = dedup(df, keys, keep="first", order_by=sorts)
    copies = df.groupBy(*keys).agg(counted).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [picked[k].eqNullSafe(copies[f"__{k}"]) for k in keys])
    return picked.join(copies, same).select(*df.columns, count_alias)


def fill_na(df: DataFrame, values) -> DataFrame:
    """One value for all columns of its type, or ``{column: value}``."""
    return df.fillna(values)


def drop_na(df: DataFrame, how: str = "any", subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how, subset=list(subset) if subset else None)


# ------------------------------------------------------------------ samples and splits


def sample(df: DataFrame, fraction: float, *, replacement: bool = False, seed: int | None = None) -> DataFrame:
    return df.sample(replacement, fraction, seed)


def hash_fraction(df: DataFrame, by: Sequence[str]) -> Column:
    """A number in [0, 1) fixed by the key values: the same row lands on the same side in every run."""
    return F.pmod(F.xxhash64(*by), F.lit(1_000_000)) / F.lit(1_000_000)


def stratified_sample(df: DataFrame, column: str, fractions: Mapping, seed: int = 0) -> DataFrame:
    return df.sampleBy(column, dict(fractions), seed)


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 0, alias: str = "split") -> DataFrame:
    """Label rows with a split number. The draw is a hash of the row and the seed, so parts neither
    overlap nor lose rows when a task is run again (identical rows share a side)."""
    draw = F.pmod(F.xxhash64(row_hash(df), F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000)
    return _label_by_weight(df, draw, weights, alias)


def hash_split(df: DataFrame, by: Sequence[str], weights: Sequence[float], alias: str = "split") -> DataFrame:
    """Split by key: all rows of a key stay together."""
    return _label_by_weight(df, hash_fraction(df, by), weights, alias)


def _label_by_weight(df, draw: Column, weights, alias):
    total, upto, label = sum(weights), 0.0, None
    for i, w in enumerate(weights[:-1]):
        upto += w / total
        label = F.when(draw < upto, F.lit(i)) if label is None else label.when(draw < upto, F.lit(i))
    last = F.lit(len(weights) - 1)
    return df.withColumn(alias, last if label is None else label.otherwise(last))


def time_split(df: DataFrame, ts: str, cutoffs: Sequence[str], alias: str = "split") -> DataFrame:
    """0 before the first cutoff, 1 up to the second, and so on."""
    return df.withColumn(alias, sum(((F.col(ts) >= F.lit(c).cast("timestamp_ntz")).cast("int") for c in cutoffs), F.lit(0)))


# ------------------------------------------------------------------ layouts


def conform(df: DataFrame, layout: StructType, *, case_sensitive: bool = False) -> DataFrame:
    """Project to a target layout: columns matched by name, cast tolerantly, missing ones NULL."""
    key: Callable[[str], str] = (lambda s: s) if case_sensitive else str.lower
    have = {key(c): c for c in df.columns}
    return df.select(*[
        (F.col(have[key(f.name)]).try_cast(f.dataType) if key(f.name) in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in layout.fields
    ])


def conform_report(df: DataFrame, layout: StructType) -> DataFrame:
    """One row per target column: present or not, and how many values fail to convert. One pass."""
    have = {c.lower(): c for c in df.columns}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(layout.fields):
        if f.name.lower() in have:
            c = F.col(have[f.name.lower()])
            aggs.append(F.count_if(c.isNotNull() & c.try_cast(f.dataType).isNull()).alias(f"f{i}"))
    row = df.agg(*aggs)
    items = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.name.lower() in have).alias("present"),
                 (F.col(f"f{i}") if f.name.lower() in have else F.col("__n")).alias("failed_or_missing"))
        for i, f in enumerate(layout.fields)
    ]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def layout_check(df: DataFrame, layout: StructType, mode: str = "exact") -> list[str]:
    """Differences between two layouts (metadata only). ``mode`` = exact | subset | superset."""
    have = {f.name.lower(): f.dataType for f in df.schema}
    want = {f.name.lower(): f.dataType for f in layout}
    problems = []
    if mode in ("exact", "superset"):
        problems += [f"missing {n}" for n in want if n not in have]
    if mode in ("exact", "subset"):
        problems += [f"unexpected {n}" for n in have if n not in want]
    return problems + [f"type of {n}: {have[n].simpleString()} is not {want[n].simpleString()}"
                       for n in have if n in want and have[n] != want[n]]


def map_values(df: DataFrame, column: str, mapping: Mapping, *, unmatched: str = "keep", default=None, alias: str | None = None) -> DataFrame:
    """Replace values by a small literal map. ``unmatched`` = keep | null | default."""
    c = F.col(column)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    other = {"keep": c, "null": F.lit(None), "default": operand(F.lit(default))}[unmatched]
    hit = c.isin(list(mapping))
    return df.withColumn(alias or column, F.when(hit, found).otherwise(other))
