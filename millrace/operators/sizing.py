"""Size checks that decide between physical strategies.

Nothing is broadcast on faith: a side is measured first by one distributed aggregate, and
when it does not fit the caller takes a shuffled route instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from millrace.session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
MAX_GROUP_ROWS = 2_000_000
MAX_LISTED_GROUPS = 1_000


def measured_bytes(df: DataFrame) -> int:
    """Serialised size of all rows (one aggregate; only a number reaches the driver)."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.agg(F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("b")).first()["b"]


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of the result, without a job; for stored tables that of the columns read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def unique_by_plan(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the plan itself shows that ``keys`` are unique, as after an aggregate by them; no job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    output = plan.output()
    names = {output.apply(i).exprId().id(): output.apply(i).name() for i in range(output.size())}
    sets = plan.distinctKeys().iterator()
    while sets.hasNext():
        parts, found = sets.next().iterator(), set()
        while parts.hasNext():
            part = parts.next()
            found.add(names.get(part.exprId().id()) if part.getClass().getSimpleName() == "AttributeReference" else None)
        if found <= set(keys):
            return True
    return False


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds the broadcast hint when the measured size fits; otherwise Spark shuffles as usual.

    A side that the optimizer puts far above the limit is not measured, so measuring reads little.
    """
    return F.broadcast(df) if estimated_bytes(df) <= 4 * max_bytes and measured_bytes(df) <= max_bytes else df


def join_back(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join statistics (one row per group) to the rows of the group; NULL keys are a group like any other.

    The statistics are written first. Small ones, as usual with few groups, are then broadcast, so
    the rows are not shuffled on the group key; else adaptive execution can split crowded groups.
    """
    own = {k: f"__key_{i}" for i, k in enumerate(keys)}
    stats = broadcast_if_small(materialise(stats.withColumnsRenamed(own), "stats"))
    same = reduce(lambda a, b: a & b, [df[f"`{k}`"].eqNullSafe(stats[own[k]]) for k in keys])
    return df.join(stats, same, how).drop(*own.values())


@dataclass
class HotGroups:
    """Keys that own more rows than one task should take."""

    frame: DataFrame            # key columns only
    count: int | None           # None: more than can be listed, so ``frame`` is a distributed table
    rows: int                   # rows in all of them

    @property
    def any(self) -> bool:
        return self.count is None or self.count > 0


SKETCH_ITEMS = 1 << 16
SKETCH_GROUPS = 64


def hot_candidates(df: DataFrame, keys: Sequence[str], max_rows: int, items: int = SKETCH_ITEMS) -> tuple[int, list[int] | None]:
    """(rows, hashes of the keys that may own more than ``max_rows`` of them) from one pass that reads the keys only.

    Each task keeps a frequent-items sketch of key hashes. The sketches merge in two steps, ``SKETCH_GROUPS`` at a
    time, so no single task receives them all and no key is shuffled. A sketch for ``items`` has a table of
    2^ceil(log2(items / 0.75)) counters, and its error is at most 3.5 rows in that many; it names every key above
    twice its error. Where that bound exceeds ``max_rows`` the table is too long for the sketch and None is returned.
    """
    hashed = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h"))
    parts = (hashed.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
             .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(h, {items})").alias("s")))
    # Grouped by a constant, since sketches cannot be combined where there are none.
    whole = parts.groupBy(F.lit(True).alias("all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {items}), {items})").alias("top")).first()
    if whole is None:
        return 0, []
    counters = 1 << (int(items / 0.75) - 1).bit_length()
    if 2 * 3.5 * whole["n"] / counters > max_rows:
        return whole["n"], None
    # An estimate lies within one error of the truth, which is at most half of ``max_rows`` here.
    return whole["n"], [r["item"] for r in whole["top"] if 2 * r["count"] > max_rows]


def hot_groups(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS, *, screen: bool = False, sketch: bool = False) -> HotGroups:
    """Find the groups above ``max_rows``.

    Counting combines on the map side, so a dominant key costs one partial row per task. With ``sketch`` only the
    rows of keys that a sketch names are counted, so a table without hot keys shuffles none of its keys; a table
    too long for the sketch is counted whole. Results are the same. At most ``MAX_LISTED_GROUPS`` keys are listed on the driver; beyond that the keys stay a DataFrame.
    ``screen`` counts all rows first, which file footers answer for a stored table: when the whole
    table fits, no group can be too large.
    """
    spark = df.sparkSession
    if screen and keys and df.count() <= max_rows:
        return HotGroups(df.select(*keys).limit(0), 0, 0)
    if not keys:
        n = df.count()
        return HotGroups(spark.range(1).select(), 1 if n > max_rows else 0, n)
    if sketch:
        maybe = hot_candidates(df, keys, max_rows)[1]
        if maybe == []:
            return HotGroups(df.select(*keys).limit(0), 0, 0)
        if maybe:       # no more than the sketch holds, eight bytes each
            named = F.broadcast(spark.createDataFrame([(h,) for h in maybe], "__h BIGINT"))
            df = df.select(*keys).join(named, F.xxhash64(*[F.col(f"`{k}`") for k in keys]) == F.col("__h"), "left_semi")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > max_rows)
    listed: list[Row] = counts.limit(MAX_LISTED_GROUPS + 1).collect()
    if len(listed) > MAX_LISTED_GROUPS:
        return HotGroups(counts.select(*keys), None, counts.agg(F.sum("__rows").alias("n")).first()["n"])
    total = sum(r["__rows"] for r in listed)
    schema = counts.select(*keys).schema
    return HotGroups(spark.createDataFrame([tuple(r)[:-1] for r in listed], schema), len(listed), total)


def row_hash(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """Hash of a whole row: a salt that stays the same when a lost task is run again."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in set(exclude)])
