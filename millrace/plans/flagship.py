"""The end-to-end query: customers and orders cleaned, joined, aggregated and ranked."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, quality, rows, windows
from millrace.operators.aggregates import Agg
from millrace.operators.conditions import case_when
from millrace.operators.quality import Rule
from millrace.operators.windows import WindowFn
from millrace.plans.registry import day, money, query, sql_day


@query("T1", "T2", "T7", "T12", "T22", "J2", "A1", "W1", "T6", sql=f"""
WITH c AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 5000 THEN 'GOLD' WHEN c_acctbal > 1000 THEN 'SILVER' ELSE 'BRONZE' END AS tier FROM customer WHERE c_acctbal > 0),
a AS (SELECT c_custkey, c_name, c_nationkey, tier, CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total_spend, COUNT(*) AS order_count, {sql_day('MAX(o_orderdate)')} AS last_order_date
  FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice >= 0 GROUP BY 1, 2, 3, 4)
SELECT c_custkey, c_name, c_nationkey, tier, total_spend, order_count, last_order_date, total_spend / order_count AS avg_order_value, rank() OVER w AS spend_rank, row_number() OVER w AS row_num,
  CAST(SUM(CAST(total_spend AS DECIMAL(25,2))) OVER (PARTITION BY c_nationkey ORDER BY total_spend DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_spend, percent_rank() OVER w <= 0.1 AS is_top_10_pct
FROM a WINDOW w AS (PARTITION BY c_nationkey ORDER BY total_spend DESC, c_custkey)""")
def customer_spend_ranking(t):
    tier = case_when([("c_acctbal > 5000", "'GOLD'"), ("c_acctbal > 1000", "'SILVER'")], "'BRONZE'")
    customers = rows.select_columns(rows.filter_rows(t.customer, "c_acctbal > 0"), ["c_custkey", "c_name", "c_nationkey"], {"tier": tier})
    orders = rows.filter_rows(t.orders, "o_orderstatus IN ('F', 'O') AND o_orderdate >= timestamp_ntz'1996-01-01'")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", money("o_totalprice").alias("price"))
    orders = rows.dedup(orders, ["o_orderkey"], keep="last", order_by=["o_orderdate"])
    orders = quality.keep_valid(orders, [Rule("key", "not_null", "o_custkey"), Rule("price", "range", "price", low=0)])
    # Aggregate before the join: one row per customer meets the customer table.
    spend = aggregates.aggregate(orders, ["o_custkey"], [Agg("sum", "price", "spend"), Agg("count", "*", "order_count"), Agg("max", "o_orderdate", "last_order")])
    joined = joins.join(spend, customers, [("o_custkey", "c_custkey")], "right").drop("o_custkey").filter("order_count IS NOT NULL")
    order = [("spend", "desc"), "c_custkey"]
    ranked = windows.window(joined, [WindowFn("rank", "spend_rank"), WindowFn("row_number", "row_num"), WindowFn("percent_rank", "pct"), WindowFn("sum", "cumulative", "spend")],
                            partition_by=["c_nationkey"], order_by=order, frame=windows.RUNNING_ROWS, counts_from=t.customer)
    return rows.derive(ranked, [("total_spend", "spend", "double"), ("avg_order_value", "total_spend / order_count"), ("cumulative_spend", "cumulative", "double"), ("is_top_10_pct", "pct <= 0.1")]).select(
        "c_custkey", "c_name", "c_nationkey", "tier", "total_spend", "order_count", day("last_order").alias("last_order_date"), "avg_order_value",
        F.col("spend_rank").cast("bigint").alias("spend_rank"), F.col("row_num").cast("bigint").alias("row_num"), "cumulative_spend", "is_top_10_pct")
