"""Upserts, dimensions, change flags, keys and audit columns.

The old state is each customer's orders up to 1998, the new state all orders of the customers with
an open one, so inserts, updates, deletes and unchanged keys all arise from the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import merge
from millrace.plans.registry import day, query

OLD = "(SELECT o_custkey AS k, COUNT(*) AS n, MIN(o_orderpriority) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)"
NEW = "(SELECT o_custkey AS k, COUNT(*) AS n, MIN(o_orderpriority) AS p FROM orders GROUP BY 1 HAVING COUNT(*) FILTER (WHERE o_orderstatus = 'O') > 0)"


def _state(t, condition):
    return t.orders.filter(condition).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p"))


def _old(t):
    return _state(t, "o_orderdate < timestamp_ntz'1998-01-01'")


def _new(t):
    state = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return state.filter("open > 0").drop("open")


@query("M1", sql=f"SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN s.k IS NULL THEN t.p ELSE s.p END AS p FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k")
def upsert_all_columns(t):
    return merge.upsert(_old(t), _new(t), ["k"])


@query("M1", sql=f"SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN t.k IS NULL THEN s.p ELSE t.p END AS p FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k")
def upsert_listed_columns(t):
    return merge.upsert(_old(t), _new(t), ["k"], update_columns=["n"])


@query("D-M3", sql=f"""
SELECT s.k, s.n, s.p, CASE WHEN t.k IS NULL OR t.n IS DISTINCT FROM s.n OR t.p IS DISTINCT FROM s.p THEN '2000-06-30' ELSE '1996-01-01' END AS changed FROM {NEW} s LEFT JOIN {OLD} t ON t.k = s.k""")
def upsert_skip_unchanged_delete(t):
    target = _old(t).withColumn("changed", F.lit("1996-01-01"))
    return merge.upsert(target, _new(t), ["k"], skip_unchanged=True, delete_unmatched=True, stamp=("changed", F.lit("2000-06-30")))


@query("D-M3", sql=f"SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN s.k IS NULL THEN t.p ELSE s.p END AS p, s.k IS NULL AS deleted FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k")
def upsert_soft_delete(t):
    return merge.upsert(_old(t).withColumn("deleted", F.lit(False)), _new(t), ["k"], soft_delete="deleted")


@query("M1", sql="""
SELECT c_custkey AS k, coalesce(o_orderkey, 0) AS last_order, coalesce(o_totalprice, c_acctbal) AS amount FROM customer LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) ON o_custkey = c_custkey""")
def upsert_latest_source_row(t):
    """Several source rows per key: the latest one counts."""
    target = t.customer.select(F.col("c_custkey").alias("k"), F.lit(0).cast("bigint").alias("last_order"), F.col("c_acctbal").alias("amount"))
    source = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("amount"), "o_orderdate")
    return merge.upsert(target, source, ["k"], update_columns=["last_order", "amount"], latest_by=["o_orderdate", "last_order"])


@query("D-M1", sql=f"""
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN s.k IS NULL THEN t.p ELSE s.p END AS p,
  CASE WHEN t.k IS NULL THEN 'INSERT' WHEN s.k IS NULL THEN 'DELETE' WHEN t.n IS DISTINCT FROM s.n OR t.p IS DISTINCT FROM s.p THEN 'UPDATE' ELSE 'UNCHANGED' END AS change_type FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k""")
def change_flags(t):
    return merge.cdc_flags(_old(t), _new(t), ["k"])


def _envelopes(t):
    """Change events that lead from the old to the new state, as JSON text."""
    row = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("k", "n", "p")])
    o, n = _old(t).select(F.struct("k", "n", "p").alias("o"), F.col("k").alias("ok")), _new(t).select(F.struct("k", "n", "p").alias("w"), F.col("k").alias("nk"))
    j = o.join(n, F.col("ok") == F.col("nk"), "full")
    op = F.when(F.col("ok").isNull(), "c").when(F.col("nk").isNull(), "d").otherwise("u")
    lsn = F.coalesce("ok", "nk") + 1
    return j.select(F.to_json(F.struct(F.col("o").alias("before"), F.col("w").alias("after"), op.alias("op"), (lsn * 1000).alias("ts_ms"), F.struct(lsn.alias("lsn")).alias("source"))).alias("value"))


@query("D-M2", sql=f"""
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN s.k IS NULL THEN t.p ELSE s.p END AS p, CASE WHEN t.k IS NULL THEN 'I' WHEN s.k IS NULL THEN 'D' ELSE 'U' END AS _cdc_op,
  (coalesce(t.k, s.k) + 1) * 1000 AS _cdc_ts, coalesce(t.k, s.k) + 1 AS _cdc_lsn FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k""")
def change_envelopes_flattened(t):
    return merge.debezium_rows(_envelopes(t), "k: bigint, n: bigint, p: string")


@query("D-M2", sql=f"SELECT * FROM {NEW}")
def change_events_applied(t):
    """The old state plus all change events is the new state."""
    changes = merge.debezium_rows(_envelopes(t), "k: bigint, n: bigint, p: string")
    return merge.apply_changes(_old(t), changes, ["k"], op="_cdc_op", order_by=["_cdc_ts", "_cdc_lsn"])


# ------------------------------------------------------------------ dimensions

HISTORY = "(SELECT o_custkey AS k, COUNT(*) AS n, MIN(o_orderpriority) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1)"


def _dimension(t):
    current = _old(t).select("k", "n", "p", F.lit("1996-01-01").cast("date").alias("effective_date"), F.lit("9999-12-31").cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    closed = _state(t, "o_orderdate < timestamp_ntz'1995-06-01'").select("k", "n", "p", F.lit("1995-06-01").cast("date").alias("effective_date"), F.lit("1996-01-01").cast("date").alias("end_date"), F.lit(False).alias("is_current"))
    return current.unionByName(closed)


def _shown(df):
    return df.withColumns({"effective_date": day("effective_date"), "end_date": day("end_date")})


def _scd2_sql(closing: str) -> str:
    changed = "t.k IS NOT NULL AND s.k IS NOT NULL AND (t.n IS DISTINCT FROM s.n OR t.p IS DISTINCT FROM s.p)"
    return f"""
WITH j AS (SELECT t.k AS tk, t.n AS tn, t.p AS tp, s.k AS sk, s.n AS sn, s.p AS sp, {changed} AS changed, t.k IS NOT NULL AND s.k IS NULL AS gone FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k)
SELECT k, n, p, '1995-06-01' AS effective_date, '1996-01-01' AS end_date, false AS is_current FROM {HISTORY}
UNION ALL SELECT tk, tn, tp, '1996-01-01', CASE WHEN {closing} THEN '2000-06-30' ELSE '9999-12-31' END, NOT ({closing}) FROM j WHERE tk IS NOT NULL
UNION ALL SELECT sk, sn, sp, '2000-06-30', '9999-12-31', true FROM j WHERE tk IS NULL OR changed"""


@query("M2", sql=_scd2_sql("changed"))
def scd2_versions(t):
    return _shown(merge.scd2(_dimension(t), _new(t), keys=["k"], tracked=["n", "p"], as_of="2000-06-30"))


@query("M2", "D-M4", sql=_scd2_sql("(changed OR gone)"))
def scd2_close_deleted(t):
    return _shown(merge.scd2(_dimension(t), _new(t), keys=["k"], tracked=["n", "p"], as_of="2000-06-30", close_deleted=True))


@query("D-M4", sql=_scd2_sql("changed"))
def scd2_second_run_changes_nothing(t):
    args = dict(keys=["k"], tracked=["n", "p"], as_of="2000-06-30")
    return _shown(merge.scd2(merge.scd2(_dimension(t), _new(t), **args), _new(t), **args))


@query("D-M4", sql=f"""
SELECT k, n, p, '1995-06-01' AS effective_date, '1996-01-01' AS end_date, false AS is_current FROM {HISTORY} UNION ALL SELECT k, n, p, '1996-01-01', '9999-12-31', true FROM {OLD}
UNION ALL SELECT k, n, p, '1995-12-01', '9999-12-31', true FROM {NEW} WHERE k NOT IN (SELECT k FROM {OLD})""")
def scd2_late_records(t):
    """A load dated before the current versions only adds keys that are new."""
    return _shown(merge.scd2(_dimension(t), _new(t), keys=["k"], tracked=["n", "p"], as_of="1995-12-01"))


@query("D-M5", sql=f"""
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL AND t.n != s.n THEN t.n END AS previous_n, CASE WHEN s.k IS NULL THEN t.p ELSE s.p END AS p FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k""")
def scd3_previous_value(t):
    target = _old(t).select("k", "n", F.lit(None).cast("bigint").alias("previous_n"), "p")
    return merge.scd3(target, _new(t), ["k"], {"n": "previous_n"})


@query("D-M5", sql=f"""
SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.n ELSE s.n END AS n, CASE WHEN s.k IS NULL THEN t.p ELSE s.p END AS p, 'current' AS part, CAST(NULL AS VARCHAR) AS changed_on FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k
UNION ALL SELECT t.k, t.n, t.p, 'history', '2000-06-30' FROM {OLD} t JOIN {NEW} s ON t.k = s.k AND (t.n != s.n OR t.p != s.p)""")
def scd4_history_table(t):
    current, history = merge.scd4(_old(t), _new(t), ["k"], ["n", "p"], as_of="2000-06-30")
    return current.select("k", "n", "p", F.lit("current").alias("part"), F.lit(None).cast("string").alias("changed_on")).unionByName(
        history.select("k", "n", "p", F.lit("history").alias("part"), day("changed_on").alias("changed_on")))


@query("D-M5", sql=f"""
WITH v AS ({_scd2_sql('changed')}), l AS (SELECT k, n FROM v WHERE is_current) SELECT v.*, coalesce(l.n, v.n) AS current_n FROM v LEFT JOIN l ON v.k = l.k""")
def scd6_hybrid(t):
    dim = _dimension(t).withColumn("current_n", F.col("n"))
    return _shown(merge.scd6(dim, _new(t), keys=["k"], tracked=["n", "p"], carry={"n": "current_n"}, as_of="2000-06-30"))


@query("D-M5", sql=f"""
WITH j AS (SELECT t.k AS tk, t.n AS tn, t.p AS tp, s.k AS sk, s.n AS sn, s.p AS sp FROM {OLD} t FULL JOIN {NEW} s ON t.k = s.k)
SELECT k, n, p, '1995-06-01' AS effective_date, '1996-01-01' AS end_date, false AS is_current FROM {HISTORY}
UNION ALL SELECT tk, tn, CASE WHEN sk IS NULL THEN tp ELSE sp END, '1996-01-01', CASE WHEN tn != sn THEN '2000-06-30' ELSE '9999-12-31' END, NOT coalesce(tn != sn, false) FROM j WHERE tk IS NOT NULL
UNION ALL SELECT sk, sn, sp, '2000-06-30', '9999-12-31', true FROM j WHERE tk IS NULL OR tn != sn""")
def scd_mixed_per_column(t):
    """``n`` is versioned, ``p`` is overwritten in place."""
    return _shown(merge.scd2(_dimension(t), _new(t), keys=["k"], tracked=["n"], type1=["p"], as_of="2000-06-30"))


# ------------------------------------------------------------------ hashes, keys, audit


@query("M3", sql="SELECT COUNT(*) AS n, COUNT(DISTINCT (p, s)) AS combinations, COUNT(DISTINCT (p, s)) AS hashes FROM (SELECT nullif(o_orderpriority, '5-LOW') AS p, nullif(o_orderstatus, 'P') AS s FROM orders)")
def change_hash_tells_nulls(t):
    df = t.orders.select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("p", "s")).alias("combinations"), F.count_distinct(merge.change_hash(["p", "s"])).alias("hashes"))


@query("M4", sql="SELECT COUNT(*) AS n, COUNT(*) AS monotonic, COUNT(*) AS uuids FROM orders")
def surrogate_unordered(t):
    """Two strategies whose values vary from run to run: as many keys as rows."""
    df = merge.surrogate_key(merge.surrogate_key(t.orders.select("o_orderkey"), "a", "monotonic"), "b", "uuid")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("monotonic"), F.count_distinct("b").alias("uuids"))


@query("M4", "D-K1", sql="SELECT c_custkey, md5(c_name || '|' || c_mktsegment) AS m, sha256(c_name || '|' || c_mktsegment) AS s FROM customer")
def surrogate_hashed(t):
    df = merge.surrogate_key(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "m", "md5", columns=["c_name", "c_mktsegment"])
    return merge.surrogate_key(df, "s", "sha256", columns=["c_name", "c_mktsegment"]).select("c_custkey", "m", "s")


@query("M5", "D-K2", "K13", "K14", sql="SELECT n_nationkey, 'run-7' AS _run_id, 'etl' AS _run_user, true AS stamped, 'nation.parquet' AS _source, length(n_name) > 0 AS hashed FROM nation")
def audit_columns(t):
    out = merge.add_audit_columns(t.nation, run_id="run-7", user="etl", record_hash="_hash", source=("_source", "nation.parquet"), run_date="_date")
    return out.select("n_nationkey", "_run_id", "_run_user", (F.to_date("_load_ts") == F.col("_date")).alias("stamped"), "_source", (F.length("_hash") == 32).alias("hashed"))

