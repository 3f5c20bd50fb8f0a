"""Arrays, maps and structs as columns and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def explode(df: DataFrame, column: str, *, outer: bool = False, alias: str | None = None, position: str | None = None) -> DataFrame:
    """One row per array element or map entry. Without an alias the column is replaced; a map
    yields ``<name>_key`` and ``<name>_value``. ``outer`` keeps rows with empty or NULL values."""
    name = alias or column
    rest = [c for c in df.columns if c != name]
    if isinstance(df.schema[column].dataType, MapType):
        names = ([position] if position else []) + [f"{name}_key", f"{name}_value"]
    else:
        names = ([position] if position else []) + [name]
    fn = {(False, False): F.explode, (True, False): F.explode_outer,
          (False, True): F.posexplode, (True, True): F.posexplode_outer}[(outer, position is not None)]
    return df.select(*rest, fn(column).alias(*names))


def flatten(df: DataFrame, columns: Sequence[str] | None = None, *, separator: str = "_", max_depth: int = 1) -> DataFrame:
    """Struct fields become columns ``parent<sep>child``, down to ``max_depth`` levels."""
    def leaves(path: Column, name: str, data_type, depth: int) -> list[Column]:
        if not isinstance(data_type, StructType) or depth >= max_depth:
            return [path.alias(name)]
        return [leaf for f in data_type.fields for leaf in leaves(path.getField(f.name), f"{name}{separator}{f.name}", f.dataType, depth + 1)]

    out: list[Column] = []
    for f in df.schema.fields:
        chosen = columns is None or f.name in columns
        out += leaves(F.col(f"`{f.name}`"), f.name, f.dataType, 0) if chosen else [F.col(f"`{f.name}`")]
    return df.select(*out)


def build_struct(df: DataFrame, alias: str, columns: Sequence[str], drop: bool = True) -> DataFrame:
    out = df.withColumn(alias, F.struct(*columns))
    return out.drop(*columns) if drop else out


def build_array(df: DataFrame, alias: str, columns: Sequence[str], drop: bool = True) -> DataFrame:
    out = df.withColumn(alias, F.array(*columns))
    return out.drop(*columns) if drop else out


def json_columns(df: DataFrame, column: str, schema, *, keep: bool = False) -> DataFrame:
    """Parse a JSON text column and spread its fields."""
    parsed = df.withColumn("__j", F.from_json(column, schema)).select("*", "__j.*").drop("__j")
    return parsed if keep else parsed.drop(column)
