"""User functions and SQL with DataFrame parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def apply_udf(df: DataFrame, fn: Callable, return_type: str, columns: Sequence[tuple[Sequence[str], str]], *, vectorised: bool = True) -> DataFrame:
    """Apply a Python callable to one or more ``(inputs, output)`` column sets.

    Vectorised functions take and return pandas Series, exchanged in Arrow batches.
    """
    udf = F.pandas_udf(fn, return_type) if vectorised else F.udf(fn, return_type, useArrow=True)
    return df.withColumns({out: udf(*[F.col(c) for c in inputs]) for inputs, out in columns})


def sql_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """Session function whose body is a SQL expression; it is inlined and optimised, never interpreted."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a function name is a single identifier")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def custom_sql(spark: SparkSession, query: str, *inputs: DataFrame, **named: DataFrame) -> DataFrame:
    """SQL over DataFrames: ``{input}``, ``{input1}``, ``{input2}`` … or names of your own."""
    tables = {f"input{i + 1}": df for i, df in enumerate(inputs)} | named
    if inputs:
        tables["input"] = inputs[0]
    used = {k: v for k, v in tables.items() if "{" + k + "}" in query}
    return spark.sql(query, **used)
