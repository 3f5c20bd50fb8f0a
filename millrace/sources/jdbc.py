"""JDBC source options. The drivers are not part of this repository."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# vendor: (URL prefix, driver class, default port) - fixed values.
VENDORS = {
    "postgresql": ("jdbc:postgresql:", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql:", "com.mysql.cj.jdbc.Driver", 3306),
    "mariadb": ("jdbc:mariadb:", "org.mariadb.jdbc.Driver", 3306),
    "sqlserver": ("jdbc:sqlserver:", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("jdbc:oracle:", "oracle.jdbc.OracleDriver", 1521),
    "db2": ("jdbc:db2:", "com.ibm.db2.jcc.DB2Driver", 50000),
    "saphana": ("jdbc:sap:", "com.sap.db.jdbc.Driver", 30015),
    "teradata": ("jdbc:teradata:", "com.teradata.jdbc.TeraDriver", 1025),
    "greenplum": ("jdbc:pivotal:greenplum:", "com.pivotal.jdbc.GreenplumDriver", 5432),
    "sybase": ("jdbc:sybase:", "com.sybase.jdbc4.jdbc.SybDriver", 5000),
}
# Further drivers known by URL (fixed values).
OTHER_DRIVERS = {"jdbc:redshift:": "com.amazon.redshift.jdbc42.Driver", "jdbc:snowflake:": "net.snowflake.client.jdbc.SnowflakeDriver"}


def jdbc_url(vendor: str, host: str, database: str, port: int | None = None) -> str:
    prefix, _, default = VENDORS[vendor]
    where = f"//{host}:{port or default}"
    if vendor == "sqlserver":
        return f"{prefix}{where};databaseName={database}"
    if vendor == "oracle":
        return f"{prefix}thin:@{where}/{database}"
    if vendor == "teradata":
        return f"{prefix}//{host}/DATABASE={database},DBS_PORT={port or default}"
    if vendor == "sybase":
        return f"{prefix}Tds:{host}:{port or default}/{database}"
    if vendor == "saphana":
        return f"{prefix}{where}/?databaseName={database}"
    return f"{prefix}{where}/{database}"


def driver_for(url: str) -> str | None:
    known = {prefix: driver for prefix, driver, _ in VENDORS.values()} | OTHER_DRIVERS
    return next((driver for prefix, driver in known.items() if url.lower().startswith(prefix)), None)


def jdbc_options(url: str, *, table: str | None = None, query: str | None = None, mode: str = "FULL", watermark: tuple[str, object] | None = None,
                 num_partitions: int | None = None, partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 fetch_size: int = 10_000, push_down_predicate: bool = True, driver: str | None = None,
                 options: Mapping[str, object] | None = None) -> dict[str, str]:
    """``mode`` = FULL | INCREMENTAL (rows above the watermark) | CUSTOM_QUERY.

    A parallel read needs column, bounds and number together; without them one connection would
    carry the whole table, so a partial specification is an error.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if mode == "CUSTOM_QUERY" and query is None:
        raise ValueError("CUSTOM_QUERY needs a query")
    relation = f"({query.rstrip().rstrip(';')}) q" if query else table
    if mode == "INCREMENTAL":
        column, value = watermark
        literal = str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
        relation = f"(SELECT * FROM {relation} WHERE {column} > {literal}) w" if not query else f"(SELECT * FROM {relation} WHERE q.{column} > {literal}) w"
    out = {"url": url, "dbtable": relation, "fetchsize": str(fetch_size), "pushDownPredicate": str(push_down_predicate).lower()}
    found = driver or driver_for(url)
    if found:
        out["driver"] = found
    split = {"partitionColumn": partition_column, "lowerBound": lower_bound, "upperBound": upper_bound, "numPartitions": num_partitions}
    given = {k: str(v) for k, v in split.items() if v is not None}
    if partition_column and len(given) < 4:
        raise ValueError("a partitioned read needs partition_column, lower_bound, upper_bound and num_partitions")
    return out | given | {k: str(v) for k, v in (options or {}).items()}


def read_jdbc(spark: SparkSession, url: str, *, user: str | None = None, password: str | None = None, **kw) -> DataFrame:
    opts = jdbc_options(url, **kw)
    credentials = {k: v for k, v in {"user": user, "password": password}.items() if v}
    return spark.read.format("jdbc").options(**opts, **credentials).load()
