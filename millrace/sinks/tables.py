"""Catalogue tables, table formats, JDBC and Kafka. Connectors need their jars on the session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sinks.files import check_mode
from millrace.sources.jdbc import driver_for


def write_table(df: DataFrame, name: str, mode: str = "error", *, format: str = "parquet", partition_by: Sequence[str] = (),
                bucket_by: tuple[int, Sequence[str]] | None = None, path: str | None = None) -> None:
    """Catalogue table, created when missing. Bucketing lets later joins and groupings on the
    bucket columns run without a shuffle. ``path`` makes the table external."""
    writer = df.write.format(format).mode(check_mode(mode))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        n, columns = bucket_by
        writer = writer.bucketBy(n, *columns).sortBy(*columns)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def jdbc_write_options(url: str, table: str, *, batch_size: int = 10_000, truncate: bool = False, create_options: str | None = None,
                       options: Mapping[str, object] | None = None) -> dict[str, str]:
    out = {"url": url, "dbtable": table, "batchsize": str(batch_size), "truncate": str(truncate).lower()}
    if driver_for(url):
        out["driver"] = driver_for(url)
    if create_options:
        out["createTableOptions"] = create_options
    return out | {k: str(v) for k, v in (options or {}).items()}


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", *, connections: int | None = None, **kw) -> None:
    """Each task writes over a connection of its own; ``connections`` deals the rows to that many tasks first."""
    (df.repartition(connections) if connections else df).write.format("jdbc").options(**jdbc_write_options(url, table, **kw)).mode(check_mode(mode)).save()


def write_delta(df: DataFrame, path: str, mode: str = "append", *, partition_by: Sequence[str] = (), optimize_write: bool = False,
                auto_compact: bool = False, merge_schema: bool = False) -> None:
    opts = {"delta.autoOptimize.optimizeWrite": optimize_write, "delta.autoOptimize.autoCompact": auto_compact, "mergeSchema": merge_schema}
    writer = df.write.format("delta").mode(check_mode(mode)).options(**{k: "true" for k, v in opts.items() if v})
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def merge_condition(keys: Sequence[str], condition: str | None = None) -> str:
    return condition or " AND ".join(f"target.`{k}` = source.`{k}`" for k in keys)


def merge_delta(df: DataFrame, path: str, *, keys: Sequence[str] = (), condition: str | None = None) -> None:
    from delta.tables import DeltaTable      # only where Delta is installed

    target = DeltaTable.forPath(df.sparkSession, path).alias("target")
    target.merge(df.alias("source"), merge_condition(keys, condition)).whenMatchedUpdateAll().whenNotMatchedInsertAll().execute()


def zorder_delta(spark, path: str, columns: Sequence[str]) -> None:
    from delta.tables import DeltaTable

    DeltaTable.forPath(spark, path).optimize().executeZOrderBy(*columns)


def partition_transforms(specs: Sequence[tuple]) -> list[Column]:
    """("identity", c), ("year" | "month" | "day" | "hour", c), ("bucket", c, n); truncate transforms
    have no function in Spark, see ``create_statement``."""
    made = {"identity": F.col, "year": F.partitioning.years, "month": F.partitioning.months, "day": F.partitioning.days, "hour": F.partitioning.hours}
    return [F.partitioning.bucket(s[2], s[1]) if s[0] == "bucket" else made[s[0]](s[1]) for s in specs]


def create_statement(df: DataFrame, table: str, partitioned_by: Sequence[tuple]) -> str:
    """CREATE TABLE with the columns of ``df`` and any transform, ("truncate", c, width) included."""
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def transform(kind: str, column: str, n: int | None = None) -> str:
        if kind == "identity":
            return quoted(column)
        if kind in ("bucket", "truncate"):
            return f"{kind}({int(n)}, {quoted(column)})"
        if kind in ("year", "month", "day", "hour"):
            return f"{kind}s({quoted(column)})"
        raise ValueError(f"unknown partition transform {kind!r}")

    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"CREATE TABLE {table} ({columns}) USING iceberg PARTITIONED BY ({', '.join(transform(*s) for s in partitioned_by)})"


def write_iceberg(df: DataFrame, table: str, mode: str = "append", *, partitioned_by: Sequence[tuple] = ()) -> None:
    """append | overwrite (of the touched partitions); the table is created when missing."""
    check_mode(mode)
    missing = not df.sparkSession.catalog.tableExists(table)
    if missing and any(s[0] == "truncate" for s in partitioned_by):
        df.sparkSession.sql(create_statement(df, table, partitioned_by))
        missing = False
    writer = df.writeTo(table).using("iceberg")
    if missing:
        (writer.partitionedBy(*partition_transforms(partitioned_by)) if partitioned_by else writer).create()
    elif mode == "overwrite":
        writer.overwritePartitions()
    else:
        writer.append()


def merge_table(df: DataFrame, table: str, keys: Sequence[str]) -> None:
    """MERGE for catalogues that support it (Iceberg, Delta)."""
    on = [F.col(f"{table}.{k}") == F.col(f"source.{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    df.alias("source").mergeInto(table, cond).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def encode_kafka(df: DataFrame, key: str | None = None) -> DataFrame:
    """All columns as one JSON value, NULL fields included, with an optional text key."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_kafka(df: DataFrame, servers: str, topic: str, *, key: str | None = None, options: Mapping[str, object] | None = None) -> None:
    opts = {"kafka.bootstrap.servers": servers, "topic": topic} | {k: str(v) for k, v in (options or {}).items()}
    encode_kafka(df, key).write.format("kafka").options(**opts).save()
