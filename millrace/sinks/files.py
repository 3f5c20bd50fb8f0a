"""File sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sizing import row_hash

MODES = {"overwrite", "append", "ignore", "error"}
# Codecs each built-in format accepts (fixed values).
TEXT_CODECS = ("none", "bzip2", "gzip", "lz4", "snappy", "deflate")
CODECS = {
    "parquet": ("none", "uncompressed", "snappy", "gzip", "lzo", "brotli", "lz4", "zstd"), "orc": ("none", "zlib", "snappy", "lzo", "lz4", "zstd"),
    "csv": TEXT_CODECS, "json": TEXT_CODECS, "text": TEXT_CODECS, "xml": TEXT_CODECS, "avro": ("uncompressed", "snappy", "deflate", "bzip2"),
}


def check_mode(mode: str) -> str:
    """Unknown modes are refused; "merge" in particular never turns into an overwrite."""
    if mode not in MODES:
        raise ValueError(f"write mode {mode!r} is not one of {sorted(MODES)}; use merge.upsert for merges")
    return mode


def write_file(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", *, partition_by: Sequence[str] = (),
               num_partitions: int | None = None, compression: str | None = None, header: bool = True, delimiter: str = ",",
               salt: int = 0, max_records_per_file: int | None = None, dynamic_overwrite: bool = False,
               options: Mapping[str, object] | None = None) -> None:
    """Write files. With ``partition_by`` rows are first gathered by partition value, so a task
    writes few files; ``salt`` spreads each value over that many tasks, for values that own much of
    the table. ``dynamic_overwrite`` replaces only the partitions present in ``df``."""
    check_mode(mode)
    if compression and format in CODECS and compression not in CODECS[format]:
        raise ValueError(f"{format} has no codec {compression!r}")
    if partition_by and (num_partitions or salt):
        extra = [F.pmod(row_hash(df), F.lit(salt))] if salt > 1 else []
        df = df.repartition(*([num_partitions] if num_partitions else []), *[F.col(c) for c in partition_by], *extra)
    elif num_partitions:
        df = df.repartition(num_partitions, row_hash(df))
    writer = df.write.format(format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    opts: dict[str, object] = {}
    if compression:
        opts["compression"] = compression
    if format == "csv":
        opts |= {"header": header, "sep": delimiter}
    if dynamic_overwrite:
        opts["partitionOverwriteMode"] = "dynamic"
    if max_records_per_file:
        opts["maxRecordsPerFile"] = max_records_per_file
    writer.options(**(opts | dict(options or {}))).save(path)


def discard(df: DataFrame) -> None:
    """Run the plan and throw the rows away."""
    df.write.format("noop").mode("overwrite").save()
