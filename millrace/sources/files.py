"""File sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.paths import path_glob
from millrace.sources.schemas import parse_formatted, read_schema

# Catalogue names and Spark format names (fixed values).
FORMATS = {
    "parquet": "parquet", "csv": "csv", "json": "json", "orc": "orc", "text": "text", "xml": "xml", "avro": "avro",
    "delta": "delta", "iceberg": "iceberg", "hudi": "hudi", "fixed_width": "text", "tsv": "csv",
}
CSV_DEFAULTS = {"header": "true", "sep": ",", "encoding": "UTF-8", "mode": "FAILFAST"}
# Connector option names and the reader option each sets (fixed values).
CONNECTOR_OPTIONS = {
    "encoding": "encoding", "date_format": "dateFormat", "timestamp_format": "timestampFormat", "quote": "quote", "escape": "escape",
    "null_value": "nullValue", "line_separator": "lineSep", "corrupt_record_mode": "mode", "compression": "compression",
    "delimiter": "sep", "header": "header", "multi_line": "multiLine", "row_tag": "rowTag",
}


def connector_options(settings: Mapping[str, object]) -> dict[str, str]:
    """Reader options from stored connector settings; unset ones are left to Spark."""
    return {CONNECTOR_OPTIONS[k]: str(v).lower() if isinstance(v, bool) else str(v)
            for k, v in settings.items() if k in CONNECTOR_OPTIONS and v not in (None, "")}


def read_file(spark: SparkSession, path: str | Sequence[str], format: str = "parquet", *, fields: Sequence[Mapping] | None = None,
              schema=None, infer_schema: bool = False, connector: Mapping[str, object] | None = None, path_glob_filter: str | None = None,
              modified_after: str | None = None, modified_before: str | None = None, recursive: bool = False,
              merge_schema: bool = False, tolerant_dates: bool = False, options: Mapping[str, object] | None = None) -> DataFrame:
    """Read files; date tokens in the path become a glob. Give a schema where you can: inference
    reads text formats twice. ``fields`` may carry ``parseFormat`` for dates kept as text."""
    kind = FORMATS[format.lower()]
    opts: dict[str, object] = dict(CSV_DEFAULTS) if kind == "csv" else {}
    if format.lower() == "tsv":
        opts["sep"] = "\t"
    opts |= connector_options(connector or {})
    for key, value in {"pathGlobFilter": path_glob_filter, "modifiedAfter": modified_after, "modifiedBefore": modified_before,
                       "recursiveFileLookup": recursive or None, "mergeSchema": merge_schema or None}.items():
        if value is not None:
            opts[key] = value
    reader = spark.read.format(kind)
    declared = read_schema(fields) if fields else schema
    if declared is not None:
        reader = reader.schema(declared)
    elif infer_schema:
        opts["inferSchema"] = True
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.options(**(opts | dict(options or {}))).load([path_glob(p) for p in paths])
    return parse_formatted(df, fields, tolerant=tolerant_dates) if fields else df


def read_json(spark: SparkSession, path: str, *, multi_line: bool = False, **kw) -> DataFrame:
    return read_file(spark, path, "json", options={"multiLine": multi_line}, **kw)


def read_fixed_width(spark: SparkSession, path: str, columns: Sequence[tuple], *, trim: bool = True) -> DataFrame:
    """``columns`` = (name, width, type) in file order."""
    at, out = 1, []
    for name, width, *kind in columns:
        c = F.substring("value", at, width)
        c = F.trim(c) if trim else c
        out.append(c.cast(kind[0] if kind else "string").alias(name))
        at += width
    return spark.read.text(path_glob(path)).select(*out)


def read_csv_skipping(spark: SparkSession, path: str, schema: str, *, drop_lines: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """CSV whose preamble or trailer lines match ``drop_lines`` (a SQL condition on ``value``)."""
    lines = spark.read.text(path_glob(path)).filter(~F.expr(drop_lines))
    return lines.select(F.from_csv("value", schema, dict(options or {})).alias("r")).select("r.*")
