"""Table profiles, schema comparison and type inference, each in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from millrace.operators.aggregates import exact_percentiles, mode
from millrace.operators.windows import top_n

# Patterns used to classify text values (fixed values).
TYPE_PATTERNS = {
    "integer": r"^[+-]?\d+$",
    "decimal": r"^[+-]?\d*\.\d+$",
    "boolean": r"(?i)^(true|false|yes|no)$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$",
}


# Shapes that a text profile counts (fixed values).
TEXT_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s.]+$",
    "phone": r"^(?!\d{4}-\d{2}-\d{2}$)\+?[0-9][0-9 ().-]{5,18}[0-9]$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "uuid": r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
}
PERCENTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def profile(df: DataFrame, columns: Sequence[str] | None = None, *, exact_distinct: bool = False, rsd: float = 0.02) -> DataFrame:
    """One row per column: rows, nulls, null %, distinct, min, max, mean, stddev, text lengths,
    empty, zero and negative counts.

    One wide aggregate reads the table once, with sketches for distinct counts. ``exact_distinct``
    adds a second pass that groups (column, value) pairs, so that the wide aggregate is not
    expanded once per column.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema}
    aggs, fields = ["count(1) AS n"], []
    for i, c in enumerate(names):
        q, number, text = _quoted(c), isinstance(types[c], NumericType), isinstance(types[c], StringType)
        parts = {
            "null_count": f"count_if({q} IS NULL)",
            "distinct_count": "count_if(false)" if exact_distinct else f"approx_count_distinct({q}, {rsd})",
            "min_value": f"CAST(min({q}) AS STRING)",
            "max_value": f"CAST(max({q}) AS STRING)",
            "mean_value": f"CAST(avg({q}) AS DOUBLE)" if number else "max(CAST(NULL AS DOUBLE))",
            "stddev_value": f"stddev_samp({q})" if number else "max(CAST(NULL AS DOUBLE))",
            "zero_count": f"count_if({q} = 0)" if number else "count_if(false)",
            "negative_count": f"count_if({q} < 0)" if number else "count_if(false)",
            "empty_count": f"count_if(trim({q}) = '')" if text else "count_if(false)",
            "min_length": f"min(length({q}))" if text else "max(CAST(NULL AS INT))",
            "max_length": f"max(length({q}))" if text else "max(CAST(NULL AS INT))",
        }
        aggs += [f"{a} AS c{i}_{k}" for k, a in parts.items()]
        fields.append(f"named_struct('column_name', {_text(c)}, 'data_type', '{types[c].simpleString()}', 'row_count', n, "
                      f"'null_pct', coalesce(try_divide(c{i}_null_count * 100D, n), 0D), " + ", ".join(f"'{k}', c{i}_{k}" for k in parts) + ")")
    out = df.agg(*[F.expr(a) for a in aggs]).selectExpr(f"inline(array({', '.join(fields)}))")
    if exact_distinct:
        exact = _values(df, names).groupBy("column_name").agg(F.count("value").alias("exact"))
        out = out.join(exact, "column_name", "left").withColumn("distinct_count", F.coalesce("exact", F.lit(0))).drop("exact")
    return out


def number_profile(df: DataFrame, columns: Sequence[str] | None = None, *, bins: int = 10, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """One row per numeric column: values, variance, mode, percentiles (``PERCENTILES``) and an equal-width histogram.

    The table is read a fixed number of times, however many columns there are: once for bounds and variance, once for the
    histogram between them, once each for modes and exact percentiles. ``exact=False`` takes the
    percentiles from mergeable summaries in the first pass instead: actual values whose rank is off by at most
    1 / ``accuracy`` of the values. Values are compared as doubles; NULL and NaN are left out, and a column without
    values has NULLs and an empty histogram. On ties the mode is the smallest value.
    """
    types = {f.name: f.dataType for f in df.schema}
    names = list(columns or [c for c in df.columns if isinstance(types[c], NumericType)])
    values = {c: F.nanvl(F.col(_quoted(c)).cast("double"), F.lit(None).cast("double")) for c in names}
    points = list(PERCENTILES.values())
    aggs = []
    for i, c in enumerate(names):
        v = values[c]
        sketch = F.lit(None).cast("array<double>") if exact else F.percentile_approx(v, points, accuracy)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.var_samp(v).alias(f"var{i}"), sketch.alias(f"p{i}")]
    found = df.agg(*aggs).first()           # a few numbers for each column
    rows = [(c, found[f"n{i}"], found[f"lo{i}"], found[f"hi{i}"], found[f"var{i}"], *(found[f"p{i}"] or [None] * len(points))) for i, c in enumerate(names)]
    kinds = ", ".join(f"{k} DOUBLE" for k in ("min_value", "max_value", "variance", *PERCENTILES))
    base = df.sparkSession.createDataFrame(rows, f"column_name STRING, values_seen BIGINT, {kinds}")

    def placed(c: str, i: int):
        low, high = found[f"lo{i}"], found[f"hi{i}"]
        if low is None or low == high:
            return F.lit(0)
        return F.least(F.floor((values[c] - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")

    melted = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), values[c].alias("value"), placed(c, i).alias("bin")) for i, c in enumerate(names)]))).filter("value IS NOT NULL")
    counted = melted.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n"))
    each = [F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) for b in range(bins)]
    out = base.join(counted.groupBy("column_name").agg(F.array(*each).alias("histogram")), "column_name", "left")
    out = out.join(mode(melted, ["column_name"], "value", "mode"), "column_name", "left")
    if exact:
        out = out.drop(*PERCENTILES).join(exact_percentiles(melted, ["column_name"], "value", PERCENTILES), "column_name", "left")
    return out.select("column_name", "values_seen", "min_value", "max_value", "variance", "mode", *PERCENTILES, F.coalesce("histogram", F.array().cast("array<bigint>")).alias("histogram"))


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: values, mean length and how many values have each shape of ``TEXT_PATTERNS``; one aggregate."""
    types = {f.name: f.dataType for f in df.schema}
    names = list(columns or [c for c in df.columns if isinstance(types[c], StringType)])
    aggs, fields = [], []
    for i, c in enumerate(names):
        v = F.col(_quoted(c))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(F.length(v)).alias(f"len{i}"), *[F.count_if(v.rlike(p)).alias(f"{k}{i}") for k, p in TEXT_PATTERNS.items()]]
        fields.append(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("values_seen"), F.col(f"len{i}").alias("mean_length"), *[F.col(f"{k}{i}").alias(f"{k}_count") for k in TEXT_PATTERNS]))
    return df.agg(*aggs).select(F.inline(F.array(*fields)))


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, frequency) for all columns, counted in one grouped pass."""
    items = ", ".join(f"named_struct('column_name', {_text(c)}, 'value', CAST({_quoted(c)} AS STRING))" for c in columns)
    return df.selectExpr(f"inline(array({items}))").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency"))


def frequencies(df: DataFrame, columns: Sequence[str], k: int = 10, *, rarest: bool = False) -> DataFrame:
    """Top (or bottom) ``k`` values of each column, all columns counted in one grouped pass."""
    return top_n(_values(df, columns), k, partition_by=["column_name"], order_by=[("frequency", "asc" if rarest else "desc"), "value"], alias="position")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal-width counts; bin 0 and ``bins + 1`` hold what lies outside."""
    return df.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))


def duplicate_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of duplicated keys (or rows): groups with copies and surplus rows. Text is grouped by
    its SHA-256, so long texts are not shuffled, and copies combine before the shuffle."""
    types = {f.name: f.dataType for f in df.schema}
    by = [F.sha2(F.col(c), 256).alias(c) if isinstance(types[c], StringType) else F.col(c) for c in (keys or df.columns)]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("duplicated_keys"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def pattern_classes(df: DataFrame, column: str) -> DataFrame:
    """Shape of the values: letters become A or a, digits 9; runs are collapsed."""
    c = F.col(column)
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{Nd}+", "9")):
        c = F.regexp_replace(c, pattern, mark)
    return df.groupBy(c.alias("shape")).agg(F.count(F.lit(1)).alias("frequency"))


def infer_types(df: DataFrame, columns: Sequence[str], required_share: float = 1.0) -> DataFrame:
    """Best type for text columns from the whole table: one aggregate of match counts per column. Whole numbers are
    integer, bigint or, beyond that range, decimal; true, false, yes and no are boolean, 0 and 1 numbers."""
    aggs, fields = [], []
    for i, c in enumerate(columns):
        text, n, need = f"trim({_quoted(c)})", f"c{i}_n", f"c{i}_n * {required_share}D"
        aggs.append(f"count_if({text} != '') AS {n}")
        aggs += [f"count_if({text} RLIKE r'{p}') AS c{i}_{t}" for t, p in TYPE_PATTERNS.items()]
        aggs += [f"count_if(try_cast({text} AS {t}) IS NOT NULL AND {text} RLIKE r'{TYPE_PATTERNS['integer']}') AS c{i}_{t}" for t in ("int", "bigint")]
        hit = {t: f"c{i}_{t}" for t in TYPE_PATTERNS}
        kind = (f"CASE WHEN {n} = 0 THEN 'string' WHEN c{i}_int >= {need} THEN 'integer' WHEN c{i}_bigint >= {need} THEN 'bigint' WHEN {hit['integer']} + {hit['decimal']} >= {need} THEN 'decimal' "
                f"WHEN {hit['boolean']} >= {need} THEN 'boolean' WHEN {hit['date']} >= {need} THEN 'date' WHEN {hit['date']} + {hit['timestamp']} >= {need} THEN 'timestamp' ELSE 'string' END")
        fields.append(f"named_struct('column_name', {_text(c)}, 'values_seen', {n}, 'inferred_type', {kind})")
    return df.agg(*[F.expr(a) for a in aggs]).selectExpr(f"inline(array({', '.join(fields)}))")


def schema_changes(old: DataFrame, new: DataFrame, *, keys: Sequence[str] = ("dataset", "column_name"),
                   type_column: str = "data_type", nullable_column: str = "is_nullable") -> DataFrame:
    """Compare two snapshots of a column catalogue: ADDED, REMOVED, TYPE_CHANGED, NULLABILITY_CHANGED.
    Removals, type changes and new NOT NULL constraints are BREAKING."""
    a = old.select(*[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)], F.col(type_column).alias("old_type"), F.col(nullable_column).alias("old_null"))
    b = new.select(*keys, F.col(type_column).alias("new_type"), F.col(nullable_column).alias("new_null"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & (a[f"__a{i}"] == b[k])
    j = a.join(b, cond, "full")
    change = (F.when(F.col("__a0").isNull(), "ADDED").when(F.col(keys[0]).isNull(), "REMOVED")
              .when(F.col("old_type") != F.col("new_type"), "TYPE_CHANGED")
              .when(F.col("old_null") != F.col("new_null"), "NULLABILITY_CHANGED"))
    breaking = (F.col("change").isin("REMOVED", "TYPE_CHANGED")
                | ((F.col("change") == "NULLABILITY_CHANGED") & ~F.col("new_null"))
                | ((F.col("change") == "ADDED") & ~F.col("new_null")))
    out = j.withColumn("change", change).filter(F.col("change").isNotNull())
    names = [F.coalesce(F.col(k), F.col(f"__a{i}")).alias(k) for i, k in enumerate(keys)]
    return out.select(*names, "change", "old_type", "new_type",
                      F.when(breaking, "BREAKING").otherwise("COMPATIBLE").alias("severity"))


def column_catalogue(**tables: DataFrame) -> list[tuple]:
    """(dataset, column, type, nullable, position) rows from DataFrame schemas (metadata only)."""
    return [(t, f.name, f.dataType.simpleString(), f.nullable, i)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
