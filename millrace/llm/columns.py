"""Working on the columns that an operator needs, whatever else its input holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; nothing else can clash."""
    return df.select(*[col(theirs).alias(ours) for ours, theirs in names.items()])
