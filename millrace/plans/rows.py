"""Filters, projections, sorts, dedup, splits and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import rows, sets
from millrace.operators.conditions import Clause, Condition, Group, case_when
from millrace.operators.udfs import custom_sql, sql_function
from millrace.plans.registry import query, sql_total


@query("T1", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_include(t):
    return rows.filter_rows(t.orders, "WHERE o_orderstatus = 'F' AND o_totalprice > 100000;").select("o_orderkey", "o_totalprice")


@query("T1", sql="SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders WHERE NOT (nullif(o_orderpriority, '5-LOW') = '1-URGENT')")
def filter_exclude_drops_null(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return rows.filter_rows(df, "priority = '1-URGENT'", "EXCLUDE")


@query("D-F1", sql="""
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, 'passed' AS port FROM orders WHERE nullif(o_orderpriority, '5-LOW') = '1-URGENT'
UNION ALL SELECT o_orderkey, nullif(o_orderpriority, '5-LOW'), 'rejected' FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'""")
def filter_with_reject(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    good, bad = rows.filter_split(df, "priority = '1-URGENT'")
    return sets.union_all(good.withColumn("port", F.lit("passed")), bad.withColumn("port", F.lit("rejected")))


@query("D-F1", sql="""
SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag, CASE WHEN nullif(l_returnflag, 'N') IS NULL THEN 'null' ELSE 'complete' END AS port FROM lineitem""")
def null_filter_with_output(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    complete, missing = rows.null_split(df, ["flag"])
    return sets.union_all(complete.withColumn("port", F.lit("complete")), missing.withColumn("port", F.lit("null")))


@query("T2", sql="SELECT c_custkey, c_name, c_acctbal * 2 AS doubled, upper(c_mktsegment) || '!' AS segment FROM customer")
def select_with_expressions(t):
    return rows.select_columns(t.customer, ["c_custkey", "c_name"], {"doubled": "c_acctbal * 2", "segment": "concat(upper(c_mktsegment), '!')"})


@query("T3", sql="SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey FROM nation")
def rename_columns(t):
    return rows.rename(t.nation, {"n_nationkey": "nation_id", "n_name": "nation_name"})


@query("T4", sql="SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS c_acctbal, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def cast_columns(t):
    df = rows.cast(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), {"c_acctbal": "decimal(12,2)", "c_nationkey": "string"})
    return rows.cast(df, {"c_acctbal": "string"})


@query("T4", sql="SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no, TRY_CAST(p_name AS INTEGER) AS not_a_number FROM part")
def cast_tolerant(t):
    df = t.part.select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"), F.col("p_name").alias("not_a_number"))
    return rows.cast(df, {"brand_no": "int", "not_a_number": "int"}, tolerant=True)


@query("T5", sql="SELECT s_suppkey, s_name FROM supplier")
def drop_columns(t):
    return rows.drop(t.supplier, ["s_nationkey", "s_acctbal"])


@query("T6", sql="""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, net, net * 2 AS net2, CAST(l_quantity AS INTEGER) AS qty FROM a""")
def derive_in_order(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    out = rows.derive(df, [("net", "l_extendedprice * (1 - l_discount)"), ("net2", "net * 2"), ("qty", "l_quantity", "int")])
    return out.drop("l_extendedprice", "l_discount")


@query("T7", sql="""
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'GOLD' WHEN c_acctbal > 1000 THEN 'SILVER' ELSE 'BRONZE' END AS tier FROM customer""")
def case_when_tiers(t):
    tier = case_when([("c_acctbal > 5000", "'GOLD'"), ("c_acctbal > 1000", "'SILVER'")], "'BRONZE'")
    return t.customer.select("c_custkey", tier.alias("tier"))


@query("T8", sql="""
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority LIKE '1-%') AND (o_totalprice >= 50000 AND o_orderpriority LIKE '%URG%')""")
def condition_groups(t):
    cond = Condition([
        Group([Clause("o_orderstatus", "equals", "F"), Clause("o_orderpriority", "starts_with", "1-")], "OR"),
        Group([Clause("o_totalprice", "gte", 50000), Clause("o_orderpriority", "contains", "URG")], "AND"),
    ], "AND")
    return t.orders.filter(cond.to_column()).select("o_orderkey")


@query("T8", sql="""
SELECT o_orderkey FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
WHERE (p IS NULL AND o_totalprice < 90000) OR (p IS NOT NULL AND o_orderstatus != 'O' AND o_totalprice <= 400000 AND o_totalprice > 10)""")
def condition_null_tests(t):
    df = t.orders.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    cond = Condition([
        Group([Clause("p", "is_null"), Clause("o_totalprice", "lt", 90000)]),
        Group([Clause("p", "is_not_null"), Clause("o_orderstatus", "not_equals", "O"), Clause("o_totalprice", "lte", 400000), Clause("o_totalprice", "gt", 10)]),
    ], "OR")
    return df.filter(cond.to_column()).select("o_orderkey")


@query("T9", sql=f"""
SELECT c_mktsegment, COUNT(*) AS orders, {sql_total('o_totalprice')} AS spend FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def custom_sql_inputs(t):
    return custom_sql(t.spark, """
        SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS spend
        FROM {input1} JOIN {input2} ON c_custkey = o_custkey GROUP BY c_mktsegment""", t.customer, t.orders)


@query("T10", "T11", sql="""
SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY p DESC NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 500""")
def sort_nulls_top_k(t):
    df = t.orders.select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return rows.limit(df, 500, [("p", "desc", "first"), ("o_totalprice", "desc"), "o_orderkey"])


@query("T10", sql="SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_rows(t):
    return rows.sort(t.customer.select("c_custkey", "c_acctbal"), [("c_acctbal", "desc"), "c_custkey"])


@query("T12", sql="SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def dedup_whole_row(t):
    return rows.dedup(t.lineitem.select("l_orderkey", "l_suppkey"))


@query("T12", "D-DD", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_keep_first(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rows.dedup(df, ["l_orderkey", "l_linenumber"], keep="first", order_by=["l_extendedprice", "l_partkey", "l_quantity"])


@query("D-DD", sql="""
SELECT user_id, event_type, event_id, value, copies FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn,
         COUNT(*) OVER (PARTITION BY user_id, event_type) AS copies FROM events) WHERE rn = 1""")
def dedup_keep_last_with_count(t):
    df = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return rows.dedup(df, ["user_id", "event_type"], keep="last", order_by=["ts", "event_id"], count_alias="copies").drop("ts")


@query("T13", sql="""
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'UNKNOWN') AS priority, coalesce(nullif(o_orderstatus, 'P'), '?') AS status FROM orders""")
def fill_missing(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return rows.fill_na(df, {"priority": "UNKNOWN", "status": "?"})


@query("T14", sql="""
SELECT * FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, nullif(o_orderstatus, 'P') AS status FROM orders)
WHERE priority IS NOT NULL AND status IS NOT NULL""")
def drop_missing_any(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return rows.drop_na(df, "any", ["priority", "status"])


@query("T14", sql="""
SELECT * FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, nullif(o_orderstatus, 'P') AS status FROM orders)
WHERE priority IS NOT NULL OR status IS NOT NULL""")
def drop_missing_all(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return rows.drop_na(df, "all", ["priority", "status"])


@query("T15", sql="SELECT true AS within_bounds, true AS subset")
def sample_rows(t):
    """The share of rows lies near the fraction and sampled rows are rows of the table."""
    picked = rows.sample(t.lineitem.select("l_orderkey"), 0.25, seed=5)
    share = picked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_orderkey").isNotNull()).alias("k"))
    n = t.lineitem.agg(F.count(F.lit(1))).scalar()
    return share.select(F.col("n").between(n * 0.2, n * 0.3).alias("within_bounds"), (F.col("n") == F.col("k")).alias("subset"))


@query("D-S2", sql="SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def stratified_sample(t):
    """Fractions 1 and 0 make the draw exact: all of F, none of the rest."""
    return rows.stratified_sample(t.orders, "o_orderstatus", {"F": 1.0, "O": 0.0, "P": 0.0}, 3).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("D-S3", sql="SELECT COUNT(*) AS n, true AS parts_disjoint, true AS shares_hold FROM orders")
def hash_split_keys(t):
    """Every customer lands in one part, all rows are kept, and shares follow the weights."""
    split = rows.hash_split(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [0.8, 0.2])
    per_key = split.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    return per_key.agg(F.sum("n").alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("parts_disjoint"),
                       F.avg("b").between(0.1, 0.3).alias("shares_hold"))


@query("D-S3", sql="SELECT COUNT(*) AS n, true AS shares_hold FROM events")
def random_split_rows(t):
    split = rows.random_split(t.events, [0.7, 0.2, 0.1], seed=4)
    return split.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("split") == 0).cast("int")).between(0.65, 0.75)).alias("shares_hold"))


@query("D-S3", sql="""
SELECT CAST((ts >= TIMESTAMP '2024-01-11') AS INTEGER) + CAST((ts >= TIMESTAMP '2024-01-21') AS INTEGER) AS split, COUNT(*) AS n, MIN(event_id) AS first_id FROM events GROUP BY 1""")
def time_split_rows(t):
    split = rows.time_split(t.events, "ts", ["2024-01-11", "2024-01-21"])
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("D-F2", sql="""
SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'default' END AS route, COUNT(*) AS n FROM orders GROUP BY 1""")
def split_first_match(t):
    routed = rows.route(t.orders, [("large", "o_totalprice > 300000"), ("urgent", "o_orderpriority = '1-URGENT'")])
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("D-F2", sql="""
SELECT 'large' AS route, COUNT(*) AS n FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT 'urgent', COUNT(*) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def split_all_match(t):
    routed = rows.route_all(t.orders, [("large", "o_totalprice > 300000"), ("urgent", "o_orderpriority = '1-URGENT'")])
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("D-C1", sql="SELECT r_regionkey AS dim_regionkey_id, r_name AS dim_name_id FROM region")
def rename_by_pattern(t):
    return rows.rename_pattern(t.region, regex="^r_", replacement="", prefix="dim_", suffix="_id")


@query("D-C1", sql="SELECT c_custkey AS \"cCustkey\", c_acctbal AS \"cAcctbal\", c_name AS \"cName\" FROM customer")
def rename_case_and_reorder(t):
    df = rows.select_pattern(t.customer, "^c_(name|custkey|acctbal)$")
    return rows.reorder(rows.rename_pattern(df, style="camel"), first=["cCustkey"], last=["cName"])


LAYOUT = T.StructType([
    T.StructField("O_ORDERKEY", T.StringType()), T.StructField("o_totalprice", T.LongType()),
    T.StructField("o_orderpriority", T.IntegerType()), T.StructField("o_comment", T.StringType()),
])


@query("D-C2", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS "O_ORDERKEY", CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
       TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority, CAST(NULL AS VARCHAR) AS o_comment FROM orders""")
def conform_layout(t):
    return rows.conform(t.orders, LAYOUT)


@query("D-C2", sql="""
SELECT 'O_ORDERKEY' AS column_name, true AS present, CAST(0 AS BIGINT) AS failed_or_missing UNION ALL SELECT 'o_totalprice', true, 0
UNION ALL SELECT 'o_orderpriority', true, COUNT(*) FROM orders UNION ALL SELECT 'o_comment', false, COUNT(*) FROM orders""")
def conform_failures(t):
    return rows.conform_report(t.orders, LAYOUT)


@query("D-V1", sql="""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS kept,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS nulled,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS defaulted FROM orders""")
def value_map(t):
    m = {"F": "finished", "O": "open"}
    df = t.orders.select("o_orderkey", "o_orderstatus")
    df = rows.map_values(df, "o_orderstatus", m, alias="kept")
    df = rows.map_values(df, "o_orderstatus", m, unmatched="null", alias="nulled")
    return rows.map_values(df, "o_orderstatus", m, unmatched="default", default="other", alias="defaulted").drop("o_orderstatus")


@query("D-S1", sql=f"SELECT o_custkey, COUNT(*) AS n, true AS in_order FROM orders GROUP BY o_custkey")
def sort_within_partitions(t):
    """Rows of a customer sit together and in date order after one shuffle."""
    placed = rows.sort_within_partitions(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate", "o_orderkey"], ["o_custkey"])
    marked = placed.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    per = marked.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"),
        F.max_by("o_orderdate", "place").alias("last_placed"), F.max("o_orderdate").alias("latest"),
        (F.max("place") - F.min("place") + 1).alias("span"))
    return per.select("o_custkey", "n", ((F.col("parts") == 1) & (F.col("span") == F.col("n")) & (F.col("last_placed") == F.col("latest"))).alias("in_order"))


@query("T30", sql="SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def sql_function_call(t):
    sql_function(t.spark, "net_price", "price DOUBLE, discount DOUBLE", "DOUBLE", "price * (1 - discount)")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.expr("net_price(l_extendedprice, l_discount)").alias("net"))


@query("U1", sql="SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all_inputs(t):
    return sets.union_all(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"), t.nation.select("n_nationkey"))


@query("U2", sql="SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct_inputs(t):
    return sets.union_distinct(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select("c_custkey"))


@query("U3", "D-U2", sql="""
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, s_name, 'none', 'supplier' FROM supplier""")
def union_by_name_tagged(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return sets.union_by_name(a, b, sources=["customer", "supplier"], fill={"segment": "none"})


@query("U3", sql="""
SELECT c_custkey AS key, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, CAST(NULL AS VARCHAR) FROM supplier""")
def union_by_name_missing(t):
    return sets.union_by_name(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")),
                              t.supplier.select(F.col("s_suppkey").alias("key")), allow_missing=True)


@query("U4", sql="SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part INTERSECT SELECT o_orderkey FROM orders")
def intersect_inputs(t):
    return sets.intersect(t.lineitem.select(F.col("l_partkey").alias("k")), t.part.select("p_partkey"), t.orders.select("o_orderkey"))


@query("U5", sql="SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT s_suppkey FROM supplier")
def except_inputs(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return sets.except_(t.customer.select(F.col("c_custkey").alias("k")), urgent, t.supplier.select("s_suppkey"))


@query("D-U1", sql="SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT o_custkey FROM orders")
def intersect_all_inputs(t):
    return sets.intersect(t.lineitem.select(F.col("l_suppkey").alias("k")), t.orders.select("o_custkey"), all=True)


@query("D-U1", sql="SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT o_custkey FROM orders")
def except_all_inputs(t):
    return sets.except_(t.lineitem.select(F.col("l_suppkey").alias("k")), t.orders.select("o_custkey"), all=True)


@query("D-U1", sql="""
(SELECT o_custkey AS k FROM orders EXCEPT SELECT l_suppkey FROM lineitem) UNION ALL (SELECT l_suppkey FROM lineitem EXCEPT SELECT o_custkey FROM orders)""")
def symmetric_difference_inputs(t):
    return sets.symmetric_difference(t.orders.select(F.col("o_custkey").alias("k")), t.lineitem.select(F.col("l_suppkey").alias("k")))


@query("D-U1", sql="SELECT o_custkey AS k FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def right_only_rows(t):
    return sets.right_only(t.lineitem.select(F.col("l_suppkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")))


