"""Nested columns, partitioning, persistence and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import layout, nested, udfs
from millrace.session import scratch_path
from millrace.plans.registry import query, sql_total, total


def _packed(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return lines


@query("T20", "D-N1", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def explode_and_flatten(t):
    """Lines packed per order, exploded and flattened again give the table back."""
    rows = nested.explode(_packed(t), "lines", alias="line")
    return nested.flatten(rows.drop("lines"), ["line"]).withColumnsRenamed({"line_l_linenumber": "l_linenumber", "line_l_partkey": "l_partkey", "line_l_quantity": "l_quantity"})


@query("T20", sql="SELECT o_orderkey, l_linenumber AS line FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def explode_outer_keeps_empty(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("line"))
    df = t.orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return nested.explode(df, "line", outer=True)


@query("D-N1", sql="SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS idx, l_linenumber FROM lineitem")
def explode_with_position(t):
    out = nested.explode(_packed(t), "lines", position="idx")
    return out.select("l_orderkey", "idx", "lines.l_linenumber")


@query("T20", sql="SELECT c_custkey, unnest(['name', 'segment']) AS m_key, unnest([c_name, c_mktsegment]) AS m_value FROM customer")
def explode_map(t):
    df = t.customer.select("c_custkey", F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("m"))
    return nested.explode(df, "m")


@query("T21", "D-N1", sql="SELECT o_orderkey, o_orderstatus AS o_a_b_status, o_totalprice AS o_a_price, o_custkey AS o_cust FROM orders")
def flatten_two_levels(t):
    inner = F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("b"), F.col("o_totalprice").alias("price"))
    df = t.orders.select("o_orderkey", F.struct(inner.alias("a"), F.col("o_custkey").alias("cust")).alias("o"))
    return nested.flatten(df, max_depth=3)


@query("D-N1", sql="SELECT c_custkey, c_name AS s_c_name, c_acctbal AS s_c_acctbal, c_name || '|' || c_mktsegment AS arr FROM customer")
def struct_and_array_builders(t):
    df = t.customer.withColumn("seg", F.col("c_mktsegment")).withColumn("nm", F.col("c_name")).drop("c_nationkey", "c_mktsegment")
    df = nested.build_array(nested.build_struct(df, "s", ["c_name", "c_acctbal"]), "arr", ["nm", "seg"])
    return nested.flatten(df, ["s"]).withColumn("arr", F.array_join("arr", "|"))


@query("T20", "T21", sql="SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_column_spread(t):
    return nested.json_columns(t.events.select("event_id", "props"), "props", "k INT")


@query("T27", sql="SELECT COUNT(*) AS n, true AS one_part_per_key, true AS spread FROM orders")
def repartition_by_hash(t):
    """Each key sits in one partition; a salted layout spreads it over several."""
    once = layout.repartition(t.orders.select("o_orderstatus"), "hash", columns=["o_orderstatus"], n=8).withColumn("p", F.spark_partition_id())
    salted = layout.repartition(t.orders.select("o_orderstatus", "o_orderkey"), "hash", columns=["o_orderstatus"], n=8, salt=16).withColumn("p", F.spark_partition_id())
    per = once.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("parts"))
    wide = salted.groupBy("o_orderstatus").agg(F.count_distinct("p").alias("wide"))
    return per.join(wide, "o_orderstatus").agg(F.sum("n").alias("n"), F.bool_and(F.col("parts") == 1).alias("one_part_per_key"), F.bool_and(F.col("wide") > 1).alias("spread"))


@query("T27", sql="SELECT COUNT(*) AS n, true AS ranges_disjoint FROM orders")
def repartition_by_range(t):
    from pyspark.sql import Window as W
    placed = layout.repartition(t.orders.select("o_totalprice"), "range", columns=["o_totalprice"], n=8).withColumn("p", F.spark_partition_id())
    per = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    seen = per.withColumn("before", F.max("hi").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)))     # one row per partition
    return seen.agg(F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("lo") > F.col("before"), F.lit(True))).alias("ranges_disjoint"))


@query("T27", sql="SELECT COUNT(*) AS n, true AS even FROM lineitem")
def repartition_round_robin(t):
    sizes = layout.partition_sizes(layout.repartition(t.lineitem, "round_robin", n=6))
    return sizes.agg(F.sum("rows").alias("n"), (F.max("rows") < F.avg("rows") * 1.5).alias("even"))


@query("T27", sql="SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")
def clustered_layout(t):
    return layout.clustered(t.lineitem.select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], 8).groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("K5", sql="""
SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines, true AS fewer_files FROM lineitem, (SELECT max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem) m
WHERE l_suppkey <= s // 8""")
def z_ordered_layout(t):
    """A predicate on the second column alone: with interleaved ranks it touches fewer files than with a sort by both columns."""
    df = t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber")
    last = df.agg(F.max("l_suppkey")).first()[0] // 8
    found = {}
    for name, rows in (("z", layout.z_ordered(df, ["l_partkey", "l_suppkey"], 16, max_rows=None)), ("sorted", layout.clustered(df, ["l_partkey", "l_suppkey"], 16, max_rows=None))):
        path = scratch_path(t.spark, f"layout-{name}")
        rows.write.parquet(path)
        found[name] = t.spark.read.parquet(path).filter(F.col("l_suppkey") <= last)
    files = {k: v.select(F.input_file_name()).distinct().count() for k, v in found.items()}
    return found["z"].agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines")).withColumn("fewer_files", F.lit(files["z"] < files["sorted"]))


@query("T28", sql=f"SELECT o_orderstatus, COUNT(*) AS n, {sql_total('o_totalprice')} AS spend FROM orders GROUP BY 1")
def persisted_twice_used(t):
    kept = layout.persist(t.orders.select("o_orderstatus", "o_totalprice"), "MEMORY_AND_DISK_SER")
    counts = kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(kept.groupBy("o_orderstatus").agg(total("o_totalprice").alias("spend")), "o_orderstatus")


@query("T27", sql="SELECT l_suppkey, COUNT(*) AS rows, COUNT(*) / (SELECT COUNT(*) * 1.0::DOUBLE / COUNT(DISTINCT l_suppkey) FROM lineitem) AS times_mean FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1.02 * (SELECT COUNT(*) * 1.0::DOUBLE / COUNT(DISTINCT l_suppkey) FROM lineitem)")
def skewed_keys(t):
    return layout.skew_report(t.lineitem, ["l_suppkey"], 1.02)


@query("T27", sql="SELECT l_partkey, COUNT(*) AS rows, COUNT(*) / (SELECT median(n) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_partkey)) AS times_median FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1.5 * (SELECT median(n) FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_partkey))")
def skewed_keys_by_median(t):
    return layout.skew_report(t.lineitem, ["l_partkey"], 1.5, against="median")


@query("T29", sql="SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def vectorised_function(t):
    def gross(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
        return price * (1 - discount) * (1 + tax)
    out = udfs.apply_udf(t.lineitem, gross, "double", [(["l_extendedprice", "l_discount", "l_tax"], "gross")])
    return out.select("l_orderkey", "l_linenumber", "gross")


@query("T29", sql="SELECT p_partkey, p_name || '/' || p_brand AS label, p_type || '/' || p_name AS other FROM part")
def row_function_two_outputs(t):
    def joined(a: pd.Series, b: pd.Series) -> pd.Series:
        return a + "/" + b
    out = udfs.apply_udf(t.part, joined, "string", [(["p_name", "p_brand"], "label"), (["p_type", "p_name"], "other")])
    return out.select("p_partkey", "label", "other")
