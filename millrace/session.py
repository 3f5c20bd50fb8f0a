"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Settings the operators rely on; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keeps collect_list/collect_set and percentile sketches in hash maps for more keys per task
    # before they fall back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}


def local_session(app: str = "millrace", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass the cluster's own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a local one in local mode and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    require_local(spark.conf.get("spark.master", "local"))
    return _local_dir()


def require_local(master: str) -> None:
    """Executors of a cluster do not see a folder of the driver's machine."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder. Every executor can read it, and no two calls share one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str = "stage"):
    """Cut the lineage by writing the rows to the shared folder and reading them back.

    Unlike ``persist`` the rows survive the loss of executors, and unlike recomputation a
    non-deterministic input is fixed once.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
