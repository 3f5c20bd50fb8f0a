"""Data-quality rules, reports, anomalies and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import masking, quality
from millrace.operators.quality import Rule, TableRule
from millrace.operators.sets import union_by_name
from millrace.plans.registry import query
from millrace.session import scratch_path

SIGNED = """(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN -o_totalprice ELSE o_totalprice END AS amount, o_orderpriority AS priority FROM orders)"""
CHECKED = f"""(SELECT *, concat_ws(',', CASE WHEN status IS NULL THEN 'status_present' END, CASE WHEN amount < 0 THEN 'amount_min' END, CASE WHEN amount IS NULL OR amount > 450000 THEN 'amount_known_and_max' END,
  CASE WHEN NOT regexp_matches(priority, '^[1-4]-') THEN 'priority_form' END, CASE WHEN status = 'O' AND amount > 400000 THEN 'open_limit' END) AS failed FROM {SIGNED})"""

RULES = [
    Rule("status_present", "not_null", "status"),
    Rule("amount_min", "range", "amount", low=0),                                   # NULL passes, only the lower bound is set
    Rule("amount_known_and_max", "range", "amount", high=450000, allow_null=False),
    Rule("priority_form", "regex", "priority", pattern="^[1-4]-"),
    Rule("open_limit", "cross_column", condition="NOT coalesce(status = 'O' AND amount > 400000, false)"),
]


def _signed(t):
    p, x = F.col("o_orderpriority"), F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(p == "1-URGENT", None).when(p == "2-HIGH", -x).otherwise(x).alias("amount"), p.alias("priority"))


@query("T22", "D-Q1", sql=f"SELECT o_orderkey, status, amount, priority, failed FROM {CHECKED}")
def dq_failed_rules(t):
    out = quality.check_rows(_signed(t), RULES)
    return out.withColumn("failed", F.array_join(quality.FAILED, ",")).drop(quality.FAILED)


@query("T22", sql=f"SELECT o_orderkey, status, amount, priority FROM {CHECKED} WHERE failed = ''")
def dq_drop_action(t):
    return quality.keep_valid(_signed(t), RULES)


@query("T22", sql="SELECT o_orderkey, o_totalprice FROM orders")
def dq_fail_action(t):
    """All rows satisfy the rules, so the job passes; a bad row would stop it."""
    return quality.require(t.orders.select("o_orderkey", "o_totalprice"), [Rule("positive", "range", "o_totalprice", low=0), Rule("key", "not_null", "o_orderkey")])


@query("T24", "K15", sql=f"SELECT o_orderkey, amount, CASE WHEN failed = '' THEN 'good' ELSE 'bad' END AS port FROM {CHECKED}")
def dq_quarantine_split(t):
    """Bad rows are stored as parquet and read back; together with the good rows nothing is lost."""
    path = scratch_path(t.spark, "quarantine")
    good, _ = quality.quarantine(_signed(t), RULES, path)
    bad = t.spark.read.parquet(path)
    cut = lambda df, port: df.select("o_orderkey", "amount", F.lit(port).alias("port"))
    return union_by_name(cut(good, "good"), cut(bad, "bad"))


@query("T22", sql=f"""
SELECT r AS rule_name, 'ERROR' AS severity, COUNT(*) AS rows_checked, COUNT(*) FILTER (contains(',' || failed || ',', ',' || r || ',')) AS failed_rows, COUNT(*) FILTER (contains(',' || failed || ',', ',' || r || ',')) = 0 AS passed
FROM {CHECKED}, (SELECT unnest(['status_present', 'amount_min', 'amount_known_and_max', 'priority_form', 'open_limit']) AS r) GROUP BY r""")
def dq_warn_report(t):
    return quality.rule_report(_signed(t), RULES)


@query("T23", "D-Q1", sql="""
SELECT l_orderkey, l_linenumber, l_suppkey, concat_ws(',', CASE WHEN COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'line_unique' END, CASE WHEN l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'supplier_known' END) AS failed FROM lineitem""")
def dq_unique_and_referential(t):
    rules = [Rule("line_unique", "unique", columns=["l_orderkey", "l_linenumber"]),
             Rule("supplier_known", "referential", "l_suppkey", reference=t.supplier.filter("s_acctbal > 0"), ref_columns=["s_suppkey"])]
    out = quality.check_rows(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), rules)
    return out.withColumn("failed", F.array_join(quality.FAILED, ",")).drop(quality.FAILED)


@query("D-Q1", sql="""
SELECT o_orderkey, concat_ws(',', CASE WHEN trim(CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END) = '' THEN 'filled' END, CASE WHEN o_orderdate > TIMESTAMP '2000-12-31' THEN 'until_2000' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'listed' END,
  CASE WHEN length(o_orderpriority) NOT BETWEEN 6 AND 9 THEN 'length' END, CASE WHEN o_totalprice >= 100000 THEN 'digits' END) AS failed FROM orders""")
def dq_more_rules(t):
    rules = [Rule("filled", "not_empty", "status"), Rule("until_2000", "date_range", "o_orderdate", high="2000-12-31"), Rule("listed", "enum", "o_orderpriority", values=["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
             Rule("length", "length_range", "o_orderpriority", low=6, high=9), Rule("digits", "precision_scale", "o_totalprice", low=7, high=2)]
    df = t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")))
    return quality.check_rows(df, rules).select("o_orderkey", F.array_join(quality.FAILED, ",").alias("failed"))


@query("T25", "D-Q4", sql=f"""
SELECT * FROM (SELECT 'status nulls' AS rule_name, 'ERROR' AS severity, COUNT(*) FILTER (status IS NULL) <= 0 AS passed, CAST(COUNT(*) FILTER (status IS NULL) AS DOUBLE) AS actual_value FROM {SIGNED}
UNION ALL SELECT 'amount null %', 'WARNING', COUNT(*) FILTER (amount IS NULL) * 100.0::DOUBLE / COUNT(*) <= 50, COUNT(*) FILTER (amount IS NULL) * 100.0::DOUBLE / COUNT(*) FROM {SIGNED}
UNION ALL SELECT 'enough rows', 'INFO', COUNT(*) >= 1000, CAST(COUNT(*) AS DOUBLE) FROM orders UNION ALL SELECT 'not too many', 'ERROR', COUNT(*) <= 10, CAST(COUNT(*) AS DOUBLE) FROM orders
UNION ALL SELECT 'priority form', 'ERROR', false, CAST(COUNT(*) FILTER (NOT regexp_matches(priority, '^[1-4]-')) AS DOUBLE) FROM {SIGNED} UNION ALL SELECT 'unique keys', 'ERROR', true, 0.0 UNION ALL SELECT 'layout', 'ERROR', false, 2.0 UNION ALL SELECT 'as many as events', 'WARNING', false, CAST(COUNT(*) - (SELECT COUNT(*) FROM events) AS DOUBLE) FROM orders)""")
def dq_table_rules(t):
    df = _signed(t)
    expected = T.StructType([f for f in df.schema if f.name != "priority"] + [T.StructField("comment", T.StringType())])
    return quality.table_report(df, [
        TableRule("status nulls", "NULL_CHECK", "status"), TableRule("amount null %", "NULL_PCT", "amount", 50, severity="WARNING"), TableRule("enough rows", "ROW_COUNT_THRESHOLD", threshold=1000, severity="INFO"),
        TableRule("not too many", "ROW_COUNT_MAX", threshold=10), TableRule("priority form", "REGEX", "priority", pattern="^[1-4]-"), TableRule("unique keys", "UNIQUENESS", "o_orderkey"), TableRule("layout", "SCHEMA_DRIFT", expected=expected), TableRule("as many as events", "ROW_COUNT_SOURCE", expected=t.events, severity="WARNING")])


@query("D-Q2", sql="""
SELECT event_id, round((value - AVG(value) OVER w) / stddev_samp(value) OVER w, 6) AS z_score, abs((value - AVG(value) OVER w) / stddev_samp(value) OVER w) > 2.5 AS is_anomaly FROM events WINDOW w AS (PARTITION BY event_type)""")
def anomaly_zscore(t):
    out = quality.zscore_flags(t.events.select("event_id", "event_type", "value"), "value", group_by=["event_type"], threshold=2.5)
    return out.select("event_id", F.round("z_score", 6).alias("z_score"), "is_anomaly")


@query("D-Q2", sql="""
SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type)""")
def anomaly_iqr(t):
    return quality.iqr_flags(t.events.select("event_id", "event_type", "value"), "value", group_by=["event_type"]).select("event_id", "is_outlier")


@query("T26", sql="""
SELECT c_custkey, sha256(c_name) AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment[1:4] AS c_mktsegment, '***' AS region, '***' AS note, regexp_replace(c_name, '[0-9]', '#', 'g') AS digits FROM customer""")
def mask_basic(t):
    df = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("string").alias("region"), F.col("c_mktsegment").alias("note"), F.col("c_name").alias("digits"))
    return masking.mask(df, {"c_name": "hash", "c_acctbal": "null", "c_mktsegment": "truncate", "region": "replace", "note": "regex_replace", "digits": ("regex_replace", {"pattern": "[0-9]", "replacement": "#"})})


@query("D-Q3", sql="""
SELECT c_custkey, c_name[1:2] || repeat('*', length(c_name) - 5) || c_name[-3:] AS partial, 'u-' || sha256('k1' || c_name)[1:12] AS pseudonym, floor(c_acctbal / 1000) * 1000 AS generalised, lower(c_mktsegment)[1] || '***@example.com' AS email, true AS noise_bounded FROM customer""")
def mask_more(t):
    df = t.customer.select("c_custkey", F.col("c_name").alias("partial"), F.col("c_name").alias("pseudonym"), F.col("c_acctbal").alias("generalised"), F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("email"), F.col("c_acctbal").alias("noisy"), "c_acctbal")
    out = masking.mask(df, {"partial": ("partial", {"first": 2, "last": 3}), "pseudonym": ("pseudonym", {"key": "k1", "prefix": "u-", "length": 12}), "generalised": ("generalise", {"width": 1000}), "email": "email", "noisy": ("noise", {"amount": 5.0, "key": "k2"})})
    return out.select("c_custkey", "partial", "pseudonym", F.col("generalised").cast("double").alias("generalised"), "email", (F.abs(F.col("noisy") - F.col("c_acctbal")) <= 5.0).alias("noise_bounded"))


@query("D-Q1", "T22", "T24", sql="""
WITH c AS (SELECT o_orderkey, o_totalprice NOT BETWEEN 2000 AND 250000 AS bad_price, o_orderstatus NOT IN ('F', 'O') AS bad_status, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS late, CAST(o_orderdate AS DATE) > DATE '1998-06-30' AS recent FROM orders),
f AS (SELECT *, concat_ws(',', CASE WHEN bad_price THEN 'price' END, CASE WHEN bad_status THEN 'status' END, CASE WHEN late THEN 'priority' END, CASE WHEN recent THEN 'date' END) AS broken FROM c)
SELECT o_orderkey, 'valid' AS port, late AS flagged, broken FROM f WHERE NOT bad_price AND NOT bad_status
UNION ALL SELECT o_orderkey, 'wrong_price', late, broken FROM f WHERE bad_price UNION ALL SELECT o_orderkey, 'open_status', late, broken FROM f WHERE bad_status""")
def dq_policy_routes(t):
    """Two rules with outputs of their own, one that flags, one that only counts and one that must hold: one pass."""
    done = quality.route(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate"), [
        Rule("price", "range", "o_totalprice", low=2000, high=250000, port="wrong_price"),
        Rule("status", "enum", "o_orderstatus", values=["F", "O"], port="open_status"),
        Rule("priority", "enum", "o_orderpriority", values=["1-URGENT", "2-HIGH", "3-MEDIUM"], policy="FLAG"),
        Rule("date", "date_range", "o_orderdate", high="1998-06-30", policy="LOG"),
        Rule("key", "not_null", "o_orderkey", policy="FAIL")])
    parts = [df.select("o_orderkey", F.lit(port).alias("port"), F.col("_flag_priority").alias("flagged"), F.array_join("_failed_rules", ",").alias("broken")) for port, df in done.outputs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
