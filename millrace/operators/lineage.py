"""Producer/consumer edges and hierarchies held as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_edges(access: DataFrame, *, actor: str, dataset: str, mode: str) -> DataFrame:
    """(producer, consumer, dataset) for actors that write and read the same dataset.
    READ_WRITE counts as both; an actor is not its own consumer. The result is defined as pairs
    per dataset; the inputs are reduced to distinct actors first."""
    m = F.upper(mode)
    writers = access.filter(m.isin("WRITE", "READ_WRITE")).select(F.col(actor).alias("producer"), dataset).distinct()
    readers = access.filter(m.isin("READ", "READ_WRITE")).select(F.col(actor).alias("consumer"), dataset).distinct()
    return writers.join(readers, dataset).filter(F.col("producer") != F.col("consumer")).select("producer", "consumer", dataset)


def materialised_paths(levels: Sequence[tuple[DataFrame, str, str | None, str]], separator: str = "/") -> DataFrame:
    """Stack levels ``(table, id, parent id, label)`` from the root down into (path, depth, node).
    Each level joins its parent's paths once, so the depth of the hierarchy is the number of joins."""
    out, above = [], None
    for depth, (df, node, parent, label) in enumerate(levels):
        if above is None:
            here = df.select(F.col(node).alias("__id"), F.concat(F.lit(separator), F.col(label)).alias("path"), F.col(label).alias("node"))
        else:
            up = above.select(F.col("__id").alias("__pid"), F.col("path").alias("__pp"))
            here = df.join(up, df[parent] == up["__pid"]).select(
                F.col(node).alias("__id"), F.concat("__pp", F.lit(separator), F.col(label)).alias("path"), F.col(label).alias("node"))
        here = here.withColumn("depth", F.lit(depth))
        out.append(here)
        above = here
    return reduce(DataFrame.unionByName, out).drop("__id")


def descendants(paths: DataFrame, root: str, separator: str = "/") -> DataFrame:
    """Everything below ``root``: a prefix filter that reaches the scan as StartsWith."""
    return paths.filter(F.col("path").startswith(root + separator))
