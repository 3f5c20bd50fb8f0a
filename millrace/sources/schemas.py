"""Declared and catalogue-supplied schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names used in pipeline and catalogue definitions, and the Spark type of each (fixed values).
SIMPLE_TYPES = {
    "string": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(),
    "bigint": T.LongType(), "int8": T.LongType(), "bigserial": T.LongType(), "serial8": T.LongType(),
    "smallint": T.IntegerType(), "int2": T.IntegerType(), "int4": T.IntegerType(), "int": T.IntegerType(),
    "serial": T.IntegerType(), "serial2": T.IntegerType(), "serial4": T.IntegerType(),
    "double precision": T.DoubleType(), "float8": T.DoubleType(), "real": T.FloatType(), "float4": T.FloatType(),
    "bool": T.BooleanType(), "timestamptz": T.TimestampType(), "datetime": T.TimestampType(),
    "bytea": T.BinaryType(), "varbinary": T.BinaryType(),
}


def data_type(spec) -> T.DataType:
    """A type from a name ("numeric(12,4)", "timestamptz") or a mapping with nested parts:
    {"name": "array", "elementType": ..}, {"name": "map", "keyType": .., "valueType": ..},
    {"name": "struct", "fields": [..]}, {"name": "decimal", "precision": p, "scale": s}."""
    if isinstance(spec, T.DataType):
        return spec
    if isinstance(spec, Mapping):
        name = str(spec.get("name", "string")).lower()
        if name == "decimal":
            return T.DecimalType(spec.get("precision", 10), spec.get("scale", 2))
        if name == "array":
            return T.ArrayType(data_type(spec.get("elementType", "string")), spec.get("containsNull", True))
        if name == "map":
            return T.MapType(data_type(spec.get("keyType", "string")), data_type(spec.get("valueType", "string")), spec.get("valueContainsNull", True))
        if name == "struct":
            return struct_type(spec.get("fields", ()))
        return data_type(name)
    text = str(spec or "").strip().lower()
    sized = re.match(r"(?:decimal|numeric|number)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", text)
    if sized:
        return T.DecimalType(int(sized[1]), int(sized[2]))
    if re.match(r"(decimal|numeric|number)\b", text):
        return T.DecimalType(18, 2)
    for name in sorted(SIMPLE_TYPES, key=len, reverse=True):
        if re.match(re.escape(name) + r"\b", text):
            return SIMPLE_TYPES[name]
    return T.StringType()


def struct_type(fields: Sequence[Mapping]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], data_type(f.get("type", "string")), f.get("nullable", True)) for f in fields])


def read_schema(fields: Sequence[Mapping]) -> T.StructType:
    """The schema to read with: fields that carry a ``parseFormat`` are read as text first."""
    return T.StructType([
        T.StructField(f["name"], T.StringType() if f.get("parseFormat") else data_type(f.get("override") or f.get("type", "string")), f.get("nullable", True))
        for f in fields
    ])


def parse_formatted(df: DataFrame, fields: Sequence[Mapping], *, tolerant: bool = False) -> DataFrame:
    """Parse the text fields that carry a ``parseFormat`` to their declared date or timestamp type."""
    out = {}
    for f in fields:
        if f.get("parseFormat"):
            kind, fmt, c = data_type(f.get("override") or f.get("type")), f["parseFormat"], F.col(f["name"])
            if isinstance(kind, T.DateType):
                out[f["name"]] = (F.try_to_date if tolerant else F.to_date)(c, fmt)
            else:
                stamp = F.try_to_timestamp(c, F.lit(fmt)) if tolerant else F.to_timestamp(c, fmt)
                out[f["name"]] = stamp.cast(kind)
    return df.withColumns(out) if out else df
