"""Aggregation, pivots, order statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as agg
from millrace.operators.aggregates import Agg
from millrace.plans.registry import day, money, query, sql_total


def _priced(t):
    return t.orders.withColumn("price", money("o_totalprice"))


@query("A1", "A3", "A5", sql=f"""
SELECT o_custkey, {sql_total('o_totalprice')} AS spend, COUNT(*) AS orders, CAST(MIN(o_totalprice) AS DOUBLE) AS smallest, MAX(o_totalprice) AS largest, COUNT(DISTINCT o_orderstatus) AS statuses
FROM orders GROUP BY o_custkey HAVING COUNT(*) > 8""")
def group_having(t):
    out = agg.aggregate(_priced(t), ["o_custkey"], [
        Agg("sum", "price", "spend"), Agg("count", "*", "orders"), Agg("min", "o_totalprice", "smallest"),
        Agg("max", "o_totalprice", "largest"), Agg("countDistinct", "o_orderstatus", "statuses")], having="orders > 8")
    return out.withColumn("spend", F.col("spend").cast("double"))


@query("A2", "A3", sql=f"SELECT {sql_total('l_extendedprice')} AS revenue, COUNT(*) AS n, MAX(l_discount) AS d, {sql_total('l_extendedprice')} / COUNT(*) AS mean FROM lineitem")
def global_aggregate(t):
    df = t.lineitem.withColumn("price", money("l_extendedprice"))
    out = agg.aggregate(df, [], [Agg("sum", "price", "revenue"), Agg("count", "*", "n"), Agg("max", "l_discount", "d")])
    return out.select(F.col("revenue").cast("double").alias("revenue"), "n", "d", (F.col("revenue").cast("double") / F.col("n")).alias("mean"))


@query("A3", sql="""
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey""")
def first_last_ordered(t):
    df = t.orders.withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return agg.aggregate(df, ["o_custkey"], [Agg("first", "o_orderkey", "first_order", order_by="at"), Agg("last", "o_orderkey", "last_order", order_by="at")])


@query("A3", "F18", sql="""
SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS all_lines, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags
FROM lineitem GROUP BY l_orderkey""")
def collect_per_order(t):
    out = agg.aggregate(t.lineitem, ["l_orderkey"], [
        Agg("collect_list", "l_linenumber", "all_lines"), Agg("collect_set", "l_linenumber", "lines"), Agg("listagg", "l_returnflag", "flags", distinct=True, args=(";",))])
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("all_lines", "lines")})


@query("A4", sql="""
SELECT l_returnflag, CAST(SUM(DISTINCT CAST(l_quantity AS BIGINT)) AS BIGINT) AS distinct_qty, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, COUNT(DISTINCT l_quantity) AS quantities,
  CAST(SUM(DISTINCT CAST(l_quantity AS BIGINT)) AS DOUBLE) / COUNT(DISTINCT l_quantity) AS mean_of_distinct FROM lineitem GROUP BY l_returnflag""")
def distinct_aggregates(t):
    df = t.lineitem.withColumn("q", F.col("l_quantity").cast("bigint"))
    return agg.aggregate(df, ["l_returnflag"], [
        Agg("sum", "q", "distinct_qty", distinct=True), Agg("sum", "q", "qty"), Agg("count", "q", "quantities", distinct=True), Agg("avg", "q", "mean_of_distinct", distinct=True)])


@query("A7", sql=f"""
SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS DOUBLE) AS "F",
  CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS DOUBLE) AS "O", CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS DOUBLE) AS "P"
FROM orders GROUP BY o_orderpriority""")
def pivot_status(t):
    out = agg.pivot(_priced(t), ["o_orderpriority"], "o_orderstatus", [Agg("sum", "price", "spend")], ["F", "O", "P"])
    return out.select("o_orderpriority", *[F.col(c).cast("double").alias(c) for c in "FOP"])


@query("A7", "D-P1", sql="""
SELECT c_nationkey, COUNT(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS "n_AUTOMOBILE", COUNT(*) FILTER (c_mktsegment = 'BUILDING') AS "n_BUILDING", COUNT(*) FILTER (c_mktsegment = 'FURNITURE') AS "n_FURNITURE",
COUNT(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS "n_HOUSEHOLD", COUNT(*) FILTER (c_mktsegment = 'MACHINERY') AS "n_MACHINERY" FROM customer GROUP BY c_nationkey""")
def pivot_found_values(t):
    """Values are listed from the data (guarded), missing cells filled, columns named by pattern."""
    return agg.pivot(t.customer, ["c_nationkey"], "c_mktsegment", [Agg("count", "*", "n")], fill=0, max_columns=50, rename="n_{value}")


@query("A7", sql="""
SELECT l_returnflag, COUNT(*) FILTER (l_linestatus = 'F') AS "F_n", MAX(l_quantity) FILTER (l_linestatus = 'F') AS "F_q", COUNT(*) FILTER (l_linestatus = 'O') AS "O_n", MAX(l_quantity) FILTER (l_linestatus = 'O') AS "O_q"
FROM lineitem GROUP BY l_returnflag""")
def pivot_two_aggregates(t):
    return agg.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", [Agg("count", "*", "n"), Agg("max", "l_quantity", "q")], ["F", "O"])


@query("D-P1", sql="""
SELECT l_returnflag, COUNT(*) FILTER (l_linestatus = 'F') AS "lines_of_F", coalesce(MAX(l_quantity) FILTER (l_linestatus = 'F'), 0) AS "most_of_F", COUNT(*) FILTER (l_linestatus = 'O') AS "lines_of_O", coalesce(MAX(l_quantity) FILTER (l_linestatus = 'O'), 0) AS "most_of_O"
FROM lineitem GROUP BY l_returnflag""")
def pivot_named_by_pattern(t):
    """Several aggregates, columns named after both the value and the aggregate."""
    return agg.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", [Agg("count", "*", "lines"), Agg("max", "l_quantity", "most")], ["F", "O"], fill=0, rename="{agg}_of_{value}")


@query("A8", sql="""
SELECT p_partkey, 'p_retailprice' AS attribute, p_retailprice AS amount FROM part UNION ALL SELECT p_partkey, 'size', nullif(CAST(p_size AS DOUBLE), 1) FROM part""")
def unpivot_keep_nulls(t):
    df = t.part.select("p_partkey", "p_retailprice", F.nullif(F.col("p_size").cast("double"), F.lit(1.0)).alias("size"))
    return agg.unpivot(df, ["p_partkey"], ["p_retailprice", "size"], "attribute", "amount")


@query("D-P2", sql="""
SELECT p_partkey, 'p_retailprice' AS attribute, p_retailprice AS amount FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part WHERE p_size != 1""")
def unpivot_drop_nulls(t):
    df = t.part.select("p_partkey", "p_retailprice", F.nullif(F.col("p_size").cast("double"), F.lit(1.0)).alias("size"))
    return agg.unpivot(df, ["p_partkey"], ["p_retailprice", "size"], "attribute", "amount", drop_nulls=True)


@query("D-P2", sql="""
SELECT l_orderkey, l_linenumber, 'rates' AS kind, l_discount AS a, l_tax AS b FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'amounts', l_quantity, l_extendedprice FROM lineitem""")
def unpivot_pairs(t):
    return agg.unpivot_groups(t.lineitem, ["l_orderkey", "l_linenumber"], {"rates": ["l_discount", "l_tax"], "amounts": ["l_quantity", "l_extendedprice"]}, "kind", ["a", "b"])


@query("A9", sql=f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS total_runs, COUNT(*) FILTER (event_type = 'view') AS running_runs, COUNT(*) FILTER (event_type = 'error') AS failed_runs,
  COUNT(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / COUNT(*) AS success_rate_pct,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(15,2)) END) AS DOUBLE) / COUNT(*) FILTER (event_type = 'purchase') AS avg_success_duration,
  COUNT(*) FILTER (value > 100) AS sla_breaches, {sql_total('value')} AS volume
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def kpi_report(t):
    df = t.events.select(day("ts").alias("day"), "ts", "event_type", money("value").alias("value"))
    out = agg.run_report(df, group_by=["day"], status="event_type", success="purchase", running="view", failed="error", duration="value", sla_limit=100, volume="value",
                         period="ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-25'")
    return out.withColumn("volume", F.col("volume").cast("double"))


@query("A10", sql="""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_user(t):
    return agg.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("D-A1", sql=f"SELECT r_name, n_name, COUNT(*) AS n, {sql_total('c_acctbal')} AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region_nation(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("b", money("c_acctbal"))
    return agg.rollup(j, ["r_name", "n_name"], [Agg("count", "*", "n"), Agg("sum", "b", "balance")]).withColumn("balance", F.col("balance").cast("double"))


@query("D-A1", sql="SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(t):
    return agg.cube(t.lineitem, ["l_returnflag", "l_linestatus"], [Agg("count", "*", "n")])


@query("D-A1", sql="SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_orders(t):
    return agg.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], []], [Agg("count", "*", "n")])


@query("D-A2", sql="""
SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp, round(var_samp(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp,
  bool_and(c_acctbal > -2000) AS all_above, bool_or(c_acctbal > 9000) AS any_above, CAST(bit_and(c_custkey) AS BIGINT) AS b_and, CAST(bit_or(c_custkey) AS BIGINT) AS b_or, CAST(bit_xor(c_custkey) AS BIGINT) AS b_xor FROM customer GROUP BY c_mktsegment""")
def spread_and_bits(t):
    df = t.customer.withColumn("above", F.col("c_acctbal") > -2000).withColumn("high", F.col("c_acctbal") > 9000)
    out = agg.aggregate(df, ["c_mktsegment"], [
        Agg("stddev_samp", "c_acctbal", "sd"), Agg("stddev_pop", "c_acctbal", "sdp"), Agg("var_samp", "c_acctbal", "v"), Agg("var_pop", "c_acctbal", "vp"),
        Agg("bool_and", "above", "all_above"), Agg("bool_or", "high", "any_above"), Agg("bit_and", "c_custkey", "b_and"), Agg("bit_or", "c_custkey", "b_or"), Agg("bit_xor", "c_custkey", "b_xor")])
    return out.withColumns({c: F.round(c, 4 if c.startswith("s") else 2) for c in ("sd", "sdp", "v", "vp")})


@query("D-A2", "F28", sql="""
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag""")
def correlation_and_regression(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_pop("l_quantity", "l_extendedprice"), 2).alias("cp"),
        F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cs"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("icept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


@query("D-A2", "F28", sql="""
WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1), c AS (SELECT e.event_type, COUNT(*) AS n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1)
SELECT event_type, round(m3 / m2 ** 1.5, 5) AS skew, round(m4 / (m2 * m2) - 3, 5) AS kurt FROM c""")
def skewness_kurtosis(t):
    return t.events.groupBy("event_type").agg(F.round(F.skewness("value"), 5).alias("skew"), F.round(F.kurtosis("value"), 5).alias("kurt"))


@query("D-A2", sql="""
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY o_orderstatus""")
def percentiles_exact(t):
    out = agg.exact_percentiles(t.orders, ["o_orderstatus"], "o_totalprice", {"q1": 0.25, "med": 0.5, "p90": 0.9})
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "med", "p90")})


@query("D-A2", sql="SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS med, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def percentiles_exact_global(t):
    out = agg.exact_percentiles(t.lineitem, [], "l_extendedprice", {"med": 0.5, "p99": 0.99})
    return out.withColumns({c: F.round(c, 6) for c in ("med", "p99")})


@query("D-A2", "F28", sql="SELECT event_type, true AS median_close, true AS p90_close FROM events GROUP BY event_type")
def percentiles_approximate(t):
    """Approximate percentiles (accuracy 10000) lie within 1% of the rank of the exact ones."""
    approx = t.events.groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.9], 10000).alias("p"), F.count(F.lit(1)).alias("n"))
    near = t.events.join(approx, "event_type").groupBy("event_type").agg(
        F.abs(F.avg((F.col("value") <= F.col("p")[0]).cast("double")) - 0.5).alias("a"), F.abs(F.avg((F.col("value") <= F.col("p")[1]).cast("double")) - 0.9).alias("b"))
    return near.select("event_type", (F.col("a") < 0.01).alias("median_close"), (F.col("b") < 0.01).alias("p90_close"))


@query("D-A2", sql="""
SELECT p_type, arg_min(p_size, (-n, p_size)) AS mode FROM (SELECT p_type, p_size, COUNT(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_type""")
def mode_per_type(t):
    return agg.mode(t.part, ["p_type"], "p_size")


@query("D-A3", sql="SELECT true AS within_5pct, true AS within_1pct, COUNT(DISTINCT l_partkey) AS exact FROM lineitem")
def distinct_count_sketch(t):
    """Sketches and exact count in aggregates of their own: together, Spark would keep both sketches once per distinct key."""
    sketches = t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.05).alias("a"), F.approx_count_distinct("l_partkey", 0.01).alias("b"))
    a = sketches.withColumn("exact", t.lineitem.agg(F.count_distinct("l_partkey")).scalar())
    near = lambda c, e: F.abs(F.col(c) - F.col("exact")) <= F.col("exact") * e * 3   # three standard errors
    return a.select(near("a", 0.05).alias("within_5pct"), near("b", 0.01).alias("within_1pct"), "exact")


@query("F28", sql="""
WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) AS rx, (rank() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0) AS ry FROM lineitem)
SELECT round(corr(rx, ry), 6) AS spearman FROM r""")
def spearman_rank_correlation(t):
    return agg.spearman(t.lineitem, "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 6))


@query("D-A2", sql="SELECT width_bucket_no AS bin, COUNT(*) AS frequency FROM (SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 26 ELSE CAST(floor(o_totalprice / 20000.0) AS BIGINT) + 1 END AS width_bucket_no FROM orders) GROUP BY 1")
def histogram_prices(t):
    from millrace.operators.profile import histogram
    return histogram(t.orders, "o_totalprice", 0.0, 500000.0, 25)


