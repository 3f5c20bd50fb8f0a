"""Column masking. Every mask keeps NULL as NULL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def mask_column(name: str, data_type: DataType, method: str, **p) -> Column:
    c, text = F.col(name), F.col(name).cast("string")
    if method == "hash":
        return F.sha2(text, 256)
    if method == "null":
        return F.lit(None).cast(data_type)          # keeps the column's type
    if method == "truncate":
        return F.substring(text, 1, p.get("length", 4))
    if method == "replace":
        return F.when(c.isNotNull(), F.lit(p.get("value", "***")))
    if method == "regex_replace":
        return F.regexp_replace(text, p.get("pattern", "^.*$"), p.get("replacement", "***"))
    if method == "partial":
        first, last, mark = p.get("first", 0), p.get("last", 4), p.get("mark", "*")
        hidden = F.greatest(F.length(text) - first - last, F.lit(0))
        return F.concat(F.substring(text, 1, first), F.repeat(F.lit(mark), hidden),
                        F.right(text, F.least(F.lit(last), F.greatest(F.length(text) - first, F.lit(0)))))
    if method == "pseudonym":
        return F.concat(F.lit(p.get("prefix", "")), F.substring(F.sha2(F.concat(F.lit(p["key"]), text), 256), 1, p.get("length", 16)))
    if method == "generalise":
        width = p["width"]
        return F.floor(c / width) * width
    if method == "noise":
        # Keyed noise in +/- amount: the same row gets the same noise in a re-run task.
        unit = F.pmod(F.xxhash64(F.lit(p.get("key", "")), text), F.lit(2_000_001)) / F.lit(1_000_000.0) - 1
        return c + unit * p.get("amount", 1.0)
    if method == "email":
        local, domain = F.split_part(text, F.lit("@"), F.lit(1)), F.split_part(text, F.lit("@"), F.lit(2))
        return F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)
    raise ValueError(f"unknown mask {method!r}")


def mask(df: DataFrame, masks: Mapping[str, str | tuple[str, dict]]) -> DataFrame:
    """``{"email": "hash", "name": ("partial", {"last": 2})}`` in one projection."""
    types = {f.name: f.dataType for f in df.schema}
    out = {}
    for name, spec in masks.items():
        method, params = (spec, {}) if isinstance(spec, str) else spec
        out[name] = mask_column(name, types[name], method, **params)
    return df.withColumns(out)
