"""Window functions, sessions, scaling, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import orderstats, scaling, windows
from millrace.operators.merge import surrogate_key
from millrace.operators.windows import Frame, WindowFn
from millrace.plans.registry import money, query

STORED = {"stable_input": True}      # the input is a projection of a stored table


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", money("o_totalprice").alias("price"))


@query("W1", "W3", sql="""
SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC)""")
def rankings_with_ties(t):
    out = windows.window(t.orders, [WindowFn("rank", "rk"), WindowFn("dense_rank", "dr"), WindowFn("percent_rank", "pr"), WindowFn("cume_dist", "cd")],
                         partition_by=["o_orderpriority"], order_by=[("o_orderdate", "desc")], **STORED)
    return out.select("o_orderkey", F.col("rk").cast("bigint").alias("rk"), F.col("dr").cast("bigint").alias("dr"), "pr", "cd")


@query("W1", "W3", sql="""
SELECT o_orderkey, row_number() OVER w AS rn, CAST(ntile(4) OVER w AS BIGINT) AS quartile, CAST(ntile(7) OVER w AS BIGINT) AS seventh FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)""")
def row_numbers_and_tiles(t):
    out = windows.window(t.orders, [WindowFn("row_number", "rn"), WindowFn("ntile", "quartile"), WindowFn("ntile", "seventh", n=7)],
                         partition_by=["o_orderstatus"], order_by=["o_totalprice", "o_orderkey"], **STORED)
    return out.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in ("rn", "quartile", "seventh")])


@query("W4", sql="""
SELECT event_id, lag(value) OVER w AS prev_value, lead(event_type, 2, 'none') OVER w AS second_next, lag(value, 1, 0.0) OVER w AS prev_or_zero FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def offsets_with_defaults(t):
    fns = [WindowFn("lag", "prev_value", "value"), WindowFn("lead", "second_next", "event_type", offset=2, default="none"), WindowFn("lag", "prev_or_zero", "value", default="0.0")]
    return windows.window(t.events, fns, partition_by=["user_id"], order_by=["ts", "event_id"], **STORED).select("event_id", "prev_value", "second_next", "prev_or_zero")


@query("W2", "W5", "D-W1", sql="""
SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) OVER w AS DOUBLE) AS running, CAST(COUNT(*) OVER w AS BIGINT) AS n, MIN(o_totalprice) OVER w AS low, MAX(o_totalprice) OVER w AS high FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_rows(t):
    fns = [WindowFn("sum", "running", "price"), WindowFn("count", "n"), WindowFn("min", "low", "price"), WindowFn("max", "high", "price")]
    out = windows.window(_orders(t), fns, partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"], frame=windows.RUNNING_ROWS, **STORED)
    return out.select("o_orderkey", "n", *[F.col(c).cast("double").alias(c) for c in ("running", "low", "high")])


@query("W2", "W5", sql="""
SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) OVER w AS DOUBLE) AS upto_day, COUNT(*) OVER w AS orders FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)""")
def running_range_with_peers(t):
    out = windows.window(_orders(t), [WindowFn("sum", "upto_day", "price"), WindowFn("count", "orders")], partition_by=["o_orderstatus"], order_by=["o_orderdate"], frame=windows.RUNNING_RANGE, **STORED)
    return out.select("o_orderkey", F.col("upto_day").cast("double").alias("upto_day"), "orders")


@query("W2", "D-W1", sql="""
SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(15,2))) OVER w AS DOUBLE) / COUNT(*) OVER w AS moving_avg, CAST(SUM(CAST(value AS DECIMAL(15,2))) OVER w AS DOUBLE) AS moving_sum, MIN(value) OVER w AS moving_min FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def moving_seven_rows(t):
    df = t.events.withColumn("v", money("value"))
    out = windows.moving(df, [WindowFn("sum", "moving_sum", "v"), WindowFn("count", "n"), WindowFn("min", "moving_min", "value")], 7, partition_by=["event_type"], order_by=["ts", "event_id"], **STORED)
    return out.select("event_id", (F.col("moving_sum").cast("double") / F.col("n")).alias("moving_avg"), F.col("moving_sum").cast("double").alias("moving_sum"), "moving_min")


@query("W2", sql="""
SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) OVER w AS DOUBLE) AS around, COUNT(*) OVER w AS n FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING)""")
def sliding_range(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey", money("o_totalprice").alias("price"))
    out = windows.window(df, [WindowFn("sum", "around", "price"), WindowFn("count", "n")], partition_by=["o_orderpriority"], order_by=["o_custkey"], frame=Frame("range", -5, 2), **STORED)
    return out.select("o_orderkey", F.col("around").cast("double").alias("around"), "n")


@query("W5", sql="""
SELECT c_custkey, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,2))) OVER w AS DOUBLE) AS nation_total, COUNT(*) OVER w AS n, MAX(c_acctbal) OVER w AS best FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def whole_partition_totals(t):
    df = t.customer.withColumn("b", money("c_acctbal"))
    out = windows.window(df, [WindowFn("sum", "nation_total", "b"), WindowFn("count", "n"), WindowFn("max", "best", "c_acctbal")], partition_by=["c_nationkey"], **STORED)
    return out.select("c_custkey", F.col("nation_total").cast("double").alias("nation_total"), "n", "best")


@query("W6", "W7", "F31", sql="""
SELECT event_id, first_value(purchase IGNORE NULLS) OVER w AS first_purchase, last_value(purchase IGNORE NULLS) OVER w AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS purchase FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def first_last_value(t):
    df = t.events.withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    out = windows.window(df, [WindowFn("FIRST_VALUE", "first_purchase", "purchase"), WindowFn("LAST_VALUE", "last_purchase", "purchase")],
                         partition_by=["user_id"], order_by=["ts", "event_id"], frame=windows.RUNNING_ROWS, **STORED)
    return out.select("event_id", "first_purchase", "last_purchase")


@query("W9", "W8", sql="""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_orderpriority, '5-LOW') DESC NULLS FIRST, o_orderkey) AS rn FROM orders""")
def window_null_order(t):
    df = t.orders.withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    out = windows.window(df, [WindowFn("row_number", "rn")], partition_by=["o_orderstatus"], order_by=[("p", "desc", "first"), "o_orderkey"], **STORED)
    return out.select("o_orderkey", F.col("rn").cast("bigint").alias("rn"))


@query("D-W2", sql="""
SELECT p_brand, p_partkey, p_retailprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""")
def top_three_per_brand(t):
    out = windows.top_n(t.part, 3, partition_by=["p_brand"], order_by=[("p_retailprice", "desc"), "p_partkey"])
    return out.select("p_brand", "p_partkey", "p_retailprice", F.col("rn").cast("bigint").alias("rn"))


@query("D-W3", sql="""
SELECT event_id, COUNT(*) OVER w AS n, CAST(SUM(CAST(value AS DECIMAL(15,2))) OVER w AS DOUBLE) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")
def seven_day_range(t):
    """Seven days as a range over epoch microseconds."""
    df = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), money("value").alias("v"))
    out = windows.window(df, [WindowFn("count", "n"), WindowFn("sum", "spent", "v")], partition_by=["user_id"], order_by=["at"], frame=Frame("range", -7 * 86_400_000_000, 0), **STORED)
    return out.select("event_id", "n", F.col("spent").cast("double").alias("spent"))


@query("D-W4", sql="""
SELECT o_orderkey, nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_price FROM orders""")
def nth_value_per_customer(t):
    out = windows.window(t.orders, [WindowFn("nth_value", "second_price", "o_totalprice", offset=2)], partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"], frame=windows.WHOLE, **STORED)
    return out.select("o_orderkey", "second_price")


@query("D-W4", sql="SELECT o_orderkey, round(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS from_median FROM orders")
def median_over_partition(t):
    """The exact median per group, joined back."""
    from millrace.operators.aggregates import exact_percentiles
    m = exact_percentiles(t.orders, ["o_orderpriority"], "o_totalprice", {"med": 0.5})
    return t.orders.join(m, "o_orderpriority").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("med"), 6).alias("from_median"))


@query("D-W4", sql="""
SELECT o_orderkey, round(median(o_totalprice) OVER w, 6) AS med, COUNT(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING)""")
def moving_median(t):
    """Median and number of the rows of a moving frame per customer."""
    how = {"partition_by": ["o_custkey"], "order_by": ["o_orderdate", "o_orderkey"], "frame": Frame("rows", -4, 1)}
    out = windows.window(t.orders, [WindowFn("count", "n")], **how, **STORED)
    return orderstats.moving_median(out, "o_totalprice", "med", **how).select("o_orderkey", F.round("med", 6).alias("med"), "n")


@query("D-W4", sql="""
SELECT event_id, round(quantile_cont(value, 0.9) OVER w, 6) AS p90, round(quantile_cont(value, 0.25) OVER w, 6) AS p25, quantile_disc(value, 0.5) OVER w AS middle
FROM (SELECT *, epoch_us(ts) AS tick FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY tick RANGE BETWEEN 86400000000 PRECEDING AND 3600000000 FOLLOWING)""")
def moving_percentiles(t):
    """Percentiles of the day before and the hour after each event, among events of its kind: wide frames in large groups."""
    df = t.events.select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"), "value")
    out = orderstats.moving_quantiles(df, {"p90": 0.9, "p25": 0.25, "middle": (0.5, "disc")}, "value", partition_by=["event_type"], order_by=["tick"],
                                      frame=Frame("range", -86_400_000_000, 3_600_000_000), **STORED)
    return out.select("event_id", F.round("p90", 6).alias("p90"), F.round("p25", 6).alias("p25"), "middle")


@query("W3", "W5", sql="""
SELECT l_orderkey, l_linenumber, rank() OVER w AS rk, dense_rank() OVER w AS dr, cume_dist() OVER w AS cd, CAST(SUM(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS upto FROM lineitem
WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_returnflag)""")
def ranks_of_few_values(t):
    """Two groups, three sort values: every value has more rows than one task takes here, so peers are ranked by value."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", F.col("l_quantity").cast("bigint").alias("qty"))
    fns = [WindowFn("rank", "rk"), WindowFn("dense_rank", "dr"), WindowFn("cume_dist", "cd"), WindowFn("sum", "upto", "qty")]
    out = windows.window(df, fns, partition_by=["l_linestatus"], order_by=["l_returnflag"], frame=windows.RUNNING_RANGE, max_group_rows=500, **STORED)
    return out.select("l_orderkey", "l_linenumber", "rk", "dr", "cd", "upto")


@query("W2", "W6", sql="""
SELECT event_id, COUNT(*) OVER a AS upto_next_hour, CAST(SUM(CAST(value AS DECIMAL(15,2))) OVER a AS DOUBLE) AS spent, MAX(value) OVER b AS largest_left,
first_value(hour) OVER b AS first_hour FROM (SELECT *, epoch_us(ts) // 3600000000 AS hour FROM events)
WINDOW a AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING),
b AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN 24 PRECEDING AND UNBOUNDED FOLLOWING)""")
def open_ranges(t):
    """RANGE frames open on one side, in groups above a low limit: carried by value."""
    df = t.events.select("event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("hour"), "value", money("value").alias("v"))
    how = {"partition_by": ["event_type"], "order_by": ["hour"], "max_group_rows": 1800}
    out = windows.window(df, [WindowFn("count", "upto_next_hour"), WindowFn("sum", "spent", "v")], frame=Frame("range", windows.UNBOUNDED, 1), **how, **STORED)
    out = windows.window(out, [WindowFn("max", "largest_left", "value"), WindowFn("first", "first_hour", "hour")], frame=Frame("range", -24, windows.UNBOUNDED), **how)
    return out.select("event_id", "upto_next_hour", F.col("spent").cast("double").alias("spent"), "largest_left", "first_hour")


@query("W5", sql="""
SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER w, 1) AS sd, round(var_pop(o_totalprice) OVER w / 1e6, 1) AS vp, array_to_string(list(o_orderstatus) OVER w, '') AS states FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def moving_spread_and_lists(t):
    fns = [WindowFn("STDDEV_SAMP", "sd", "o_totalprice"), WindowFn("var_pop", "vp", "o_totalprice"), WindowFn("array_agg", "states", "o_orderstatus")]
    out = windows.moving(t.orders, fns, 4, partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"], **STORED)
    return out.select("o_orderkey", F.round("sd", 1).alias("sd"), F.round(F.col("vp") / 1e6, 1).alias("vp"), F.array_join("states", "").alias("states"))


@query("D-W5", sql="""
WITH f AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 > 14400 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM f)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, CAST(MIN(ts) AS VARCHAR) AS session_start, COUNT(*) AS events, date_diff('microsecond', MIN(ts), MAX(ts)) // 1000000 AS duration_s FROM s GROUP BY 1, 2""")
def sessions_by_gap(t):
    out = windows.session_summary(t.events, user=["user_id"], ts="ts", gap_seconds=4 * 3600, tie_breaker=["event_id"], **STORED)
    return out.select("user_id", "session_no", F.col("session_start").cast("string").alias("session_start"), "events", "duration_s")


@query("M4", sql="SELECT event_id, 1000 + 10 * (row_number() OVER (ORDER BY ts, event_id) - 1) AS sk FROM events")
def surrogate_row_number(t):
    """Gap-free keys over the whole table with start and increment."""
    return surrogate_key(t.events, "sk", "row_number", order_by=["ts", "event_id"], start=1000, increment=10, **STORED).select("event_id", "sk")


@query("F31", sql="SELECT event_id, CAST(ntile(10) OVER (ORDER BY value, event_id) AS BIGINT) AS decile FROM events")
def buckets_equal_frequency(t):
    return scaling.bucket_equal_frequency(t.events, ["value", "event_id"], 10, "decile", **STORED).select("event_id", F.col("decile").cast("bigint").alias("decile"))


@query("F31", sql="""
SELECT event_id, CAST(least(floor((value - lo) * 8 / (hi - lo)) + 1, 8) AS BIGINT) AS width_bin, CASE WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS edge_bin FROM events, (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events)""")
def buckets_width_and_edges(t):
    df = scaling.bucket_equal_width(t.events, "value", 8, "width_bin")
    return scaling.bucket_by_edges(df, "value", [10, 50, 100], "edge_bin").select("event_id", F.col("width_bin").cast("bigint").alias("width_bin"), "edge_bin")


@query("F31", sql="""
SELECT o_orderkey, round((o_totalprice - MIN(o_totalprice) OVER w) / (MAX(o_totalprice) OVER w - MIN(o_totalprice) OVER w), 9) AS unit, round((o_totalprice - AVG(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w, 6) AS z FROM orders WINDOW w AS (PARTITION BY o_orderstatus)""")
def scale_per_group(t):
    df = scaling.scale(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", "minmax", "unit", ["o_orderstatus"])
    df = scaling.scale(df, "o_totalprice", "zscore", "z", ["o_orderstatus"])
    return df.select("o_orderkey", F.round("unit", 9).alias("unit"), F.round("z", 6).alias("z"))


HOLES = "(SELECT *, CASE WHEN event_type != 'error' THEN value END AS v FROM events)"


def _holes(t):
    return t.events.withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


@query("F31", sql=f"""
SELECT event_id, coalesce(v, 0.0) AS by_constant, round(coalesce(v, (SELECT median(v) FROM {HOLES})), 6) AS by_median, coalesce(v, m) AS by_mode FROM {HOLES} LEFT JOIN
(SELECT user_id, arg_min(v, (-n, v)) AS m FROM (SELECT user_id, v, COUNT(*) AS n FROM {HOLES} WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (user_id)""")
def impute_constant_median_mode(t):
    df = _holes(t).select("event_id", "user_id", "v", F.col("v").alias("by_constant"), F.col("v").alias("by_median"), F.col("v").alias("by_mode"))
    df = scaling.impute(df, "by_constant", "constant", value=0.0)
    df = scaling.impute(df, "by_median", "median")
    return scaling.impute(df, "by_mode", "mode", group_by=["user_id"]).select("event_id", "by_constant", F.round("by_median", 6).alias("by_median"), "by_mode")


@query("F31", sql=f"SELECT event_id, round(coalesce(v, AVG(v) OVER (PARTITION BY user_id)), 6) AS v FROM {HOLES}")
def impute_mean_per_user(t):
    return scaling.impute(_holes(t).select("event_id", "user_id", "v"), "v", "mean", group_by=["user_id"]).select("event_id", F.round("v", 6).alias("v"))


@query("F31", sql=f"""
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward,
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM {HOLES}""")
def fill_forward_backward(t):
    df = scaling.fill_along(_holes(t), "v", "forward", partition_by=["user_id"], order_by=["ts", "event_id"], alias="forward")
    return scaling.fill_along(df, "v", "backward", partition_by=["user_id"], order_by=["ts", "event_id"], alias="backward").select("event_id", "forward", "backward")


@query("F31", sql=f"""
WITH k AS (SELECT event_id, user_id, ts, epoch_us(ts) AS x, v FROM {HOLES}), n AS (SELECT *,
  last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER a AS x0, last_value(v IGNORE NULLS) OVER a AS y0, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER b AS x1, first_value(v IGNORE NULLS) OVER b AS y1 FROM k
  WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v ELSE y0 + (y1 - y0) * ((x - x0) / (x1 - x0)) END, 6) AS v FROM n""")
def interpolate_linear(t):
    df = _holes(t).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = scaling.interpolate(df.select("event_id", "user_id", "ts", "at", "v"), "v", "at", partition_by=["user_id"], order_by=["ts", "event_id"], alias="filled")
    return out.select("event_id", F.round("filled", 6).alias("v"))
