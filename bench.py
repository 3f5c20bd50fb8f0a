"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans import load  # noqa: E402
from millrace.session import local_session  # noqa: E402
from millrace.sinks.files import discard  # noqa: E402

HEADLINE = (
    "customer_spend_ranking", "filter_include", "dedup_keep_first", "split_first_match", "custom_sql_inputs",
    "join_four_tables", "join_salted", "lookup_defaults", "range_join_bands", "fuzzy_levenshtein",
    "group_having", "distinct_aggregates", "pivot_found_values", "unpivot_pairs", "kpi_report", "cube_flags", "percentiles_exact",
    "rankings_with_ties", "running_rows", "moving_seven_rows", "sliding_range", "top_three_per_brand", "sessions_by_gap", "surrogate_row_number",
    "recipe_text_steps", "recipe_branches", "recipe_named_patterns", "regular_expressions", "array_higher_order", "explode_and_flatten", "vectorised_function",
    "dq_failed_rules", "dq_unique_and_referential", "dq_warn_report", "mask_basic", "profile_customer", "infer_text_types",
    "upsert_all_columns", "scd2_versions", "change_flags", "parquet_partitioned", "csv_round_trip", "stream_tumbling_complete",
)

# The same results written by hand in plain Spark, for the overhead target (at most 20 %).
def _by_hand() -> dict:
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from millrace.plans.registry import Tables

    def recipe_text_steps(spark, folder):
        c = Tables(spark, folder).customer
        n, p, m = F.col("c_name"), F.concat(F.lit("  "), "c_name", F.lit(" ")), F.col("c_mktsegment")
        return c.select("c_custkey", F.trim(p).alias("a"), F.ltrim(p).alias("b"), F.rtrim(p).alias("c"), F.upper(m).alias("d"), F.lower(m).alias("e"), F.initcap(m).alias("f"), F.length(n).alias("g"), F.concat(n, F.lit("-"), m).alias("h"),
                        F.substring(n, 3, 4).alias("i"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("j"), F.rpad(n, 5, ".").alias("k"), F.replace(n, F.lit("#"), F.lit("/")).alias("l"))

    def group_having(spark, folder):
        o = Tables(spark, folder).orders
        price = F.col("o_totalprice").cast("decimal(15,2)")
        return o.groupBy("o_custkey").agg(F.sum(price).cast("double").alias("spend"), F.count(F.lit(1)).alias("orders"), F.min("o_totalprice").alias("smallest"), F.max("o_totalprice").alias("largest"), F.count_distinct("o_orderstatus").alias("statuses")).filter("orders > 8")

    def dedup_keep_first(spark, folder):
        li = Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
        w = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_extendedprice", "l_partkey", "l_quantity")
        return li.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

    def moving_seven_rows(spark, folder):
        e = Tables(spark, folder).events
        w = W.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-6, 0)
        v = F.sum(F.col("value").cast("decimal(15,2)")).over(w).cast("double")
        return e.select("event_id", (v / F.count(F.lit(1)).over(w)).alias("moving_avg"), v.alias("moving_sum"), F.min("value").over(w).alias("moving_min"))

    def upsert_all_columns(spark, folder):
        o = Tables(spark, folder).orders
        state = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
        t, s = state(o.filter("o_orderdate < timestamp_ntz'1998-01-01'")), state(o).filter("open > 0")
        return t.join(s, t.k == s.k, "full").select(F.coalesce(s.k, t.k).alias("k"), F.coalesce(s.n, t.n).alias("n"), F.coalesce(s.p, t.p).alias("p"))

    return {f.__name__: f for f in (recipe_text_steps, group_having, dedup_keep_first, moving_seven_rows, upsert_all_columns)}


def _timed(fn, spark, folder) -> float:
    start = time.perf_counter()
    discard(fn(spark, folder))
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session("millrace-bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    discard(registry["customer_spend_ranking"](spark, folder))      # warm the session
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(statistics.median(_timed(registry[name], spark, folder) for _ in range(repeats)), 4)
    overhead = {}
    for name, by_hand in _by_hand().items():
        pairs = [(_timed(registry[name], spark, folder), _timed(by_hand, spark, folder)) for _ in range(2 * repeats + 1)]
        ours, theirs = (statistics.median(side) for side in zip(*pairs))
        overhead[name] = round(100 * (ours / theirs - 1), 1)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "repeats": repeats,
                      "overhead_pct_vs_handwritten": overhead}))
    spark.stop()


if __name__ == "__main__":
    main()
