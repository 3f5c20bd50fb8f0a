"""Joins, lookups and approximate matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans.registry import query, sql_total, total
from millrace.plans.scalars import sql_soundex


def _orders(t):
    return t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice", "o_orderpriority")


def _wealthy(t):
    return t.customer.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("custkey"), "c_name", "c_nationkey")


SAME = "(SELECT o_custkey AS custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders) o"
RICH = "(SELECT c_custkey AS custkey, c_name, c_nationkey FROM customer WHERE c_acctbal > 3000) c"


@query("J1", sql=f"SELECT custkey, o_orderkey, c_name FROM {SAME} JOIN {RICH} USING (custkey)")
def join_inner(t):
    return joins.join(_orders(t), _wealthy(t), ["custkey"], "inner").select("custkey", "o_orderkey", "c_name")


@query("J1", "J8", sql=f"SELECT custkey, o_orderkey, c_name FROM {SAME} LEFT JOIN {RICH} USING (custkey)")
def join_left(t):
    return joins.join(_orders(t), _wealthy(t), ["custkey"], "LEFT OUTER").select("custkey", "o_orderkey", "c_name")


@query("J1", "J8", sql=f"SELECT custkey, o_orderkey, c_name FROM {SAME} RIGHT JOIN {RICH} USING (custkey)")
def join_right(t):
    return joins.join(_orders(t), _wealthy(t), ["custkey"], "RIGHT OUTER").select("custkey", "o_orderkey", "c_name")


@query("J1", "J8", sql=f"SELECT custkey, o_orderkey, c_name FROM {SAME} FULL JOIN {RICH} USING (custkey)")
def join_full(t):
    return joins.join(_orders(t), _wealthy(t), ["custkey"], "FULL OUTER").select("custkey", "o_orderkey", "c_name")


@query("J1", "J8", sql=f"SELECT * FROM {SAME} WHERE EXISTS (SELECT 1 FROM {RICH} WHERE c.custkey = o.custkey)")
def join_semi(t):
    return joins.join(_orders(t), _wealthy(t), ["custkey"], "SEMI")


@query("J1", "J8", sql=f"SELECT * FROM {SAME} WHERE NOT EXISTS (SELECT 1 FROM {RICH} WHERE c.custkey = o.custkey)")
def join_anti(t):
    return joins.join(_orders(t), _wealthy(t), ["custkey"], "ANTI")


@query("J2", "J4", sql="SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def join_differing_keys(t):
    j = joins.join(t.orders, t.customer, [("o_custkey", "c_custkey")], broadcast="right")
    return joins.join(j, t.nation, [("c_nationkey", "n_nationkey")], broadcast="right").select("o_orderkey", "c_name", "n_name")


@query("J4", sql=f"SELECT n_name, COUNT(*) AS n, {sql_total('o_totalprice')} AS spend FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def join_broadcast_left(t):
    j = joins.join(t.nation, t.customer, [("n_nationkey", "c_nationkey")], broadcast="left")
    return joins.join(j, t.orders, [("c_custkey", "o_custkey")]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("spend"))


@query("J3", sql="""
SELECT l.l_orderkey, l.l_linenumber, ps.n FROM lineitem l
JOIN (SELECT l_partkey AS partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) ps ON l.l_partkey = ps.partkey AND l.l_suppkey = ps.l_suppkey""")
def join_mixed_keys(t):
    pairs = t.lineitem.groupBy(F.col("l_partkey").alias("partkey"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return joins.join(t.lineitem, pairs, [("l_partkey", "partkey"), "l_suppkey"]).select("l_orderkey", "l_linenumber", "n")


@query("J5", sql=f"SELECT o_orderkey, {sql_total('l_extendedprice')} AS revenue FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_salted(t):
    j = joins.join(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey", "l_extendedprice"), [("o_orderkey", "l_orderkey")], "left", salt=16)
    return j.groupBy("o_orderkey").agg(total("l_extendedprice").alias("revenue"))


@query("J5", sql=f"""
SELECT o_orderkey, l_linenumber, o_orderstatus, spend FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN (SELECT o_orderstatus AS status, {sql_total('o_totalprice')} AS spend FROM orders GROUP BY 1) s ON s.status = o_orderstatus WHERE l_linenumber <= 2""")
def join_salted_hot_status(t):
    """Each status owns a large share of the rows: those above a tenth of them are spread, their right rows repeated."""
    lines = joins.join(t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.filter("l_linenumber <= 2").select("l_orderkey", "l_linenumber"), [("o_orderkey", "l_orderkey")])
    spend = t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(total("o_totalprice").alias("spend"))
    return joins.join(lines, spend, [("o_orderstatus", "status")], salt=16, hot_rows=t.orders.count() // 10)


@query("J6", sql="""
SELECT s.o_orderstatus, p.o_orderpriority, COUNT(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority GROUP BY 1, 2""")
def cross_grid(t):
    """Every status with every priority, including combinations without orders."""
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    grid = joins.join(t.orders.select("o_orderstatus").distinct(), t.orders.select("o_orderpriority").distinct(), [], "cross")
    return joins.join(grid, counts, ["o_orderstatus", "o_orderpriority"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("J7", "D-J4", sql="""
SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE c_name END AS c_name, CASE WHEN c_custkey IS NULL THEN -1 ELSE nullif(c_nationkey, 3) END AS nation
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0 AND c_mktsegment != 'BUILDING') ON o_custkey = c_custkey""")
def lookup_defaults(t):
    """Defaults fill missing keys only; a genuine NULL of the reference stays NULL."""
    ref = t.customer.filter("c_acctbal > 0 AND c_mktsegment != 'BUILDING'").withColumn("nation", F.nullif("c_nationkey", F.lit(3)))
    out = joins.lookup(t.orders, ref, {"o_custkey": "c_custkey"}, ["c_name", "nation"], defaults={"c_name": "unknown", "nation": -1}, broadcast="check")
    return out.select("o_orderkey", "o_custkey", "c_name", "nation")


@query("J7", "D-J4", sql="SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def lookup_reject(t):
    return joins.lookup(t.customer.select("c_custkey", "c_nationkey"), t.nation.filter("n_regionkey = 2"), {"c_nationkey": "n_nationkey"}, ["n_name"], not_found="reject")


@query("D-J4", sql="SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def lookup_fail_policy(t):
    """Every key is present, so the job passes; a missing key stops it."""
    return joins.lookup(t.supplier.select("s_suppkey", "s_nationkey"), t.nation, {"s_nationkey": "n_nationkey"}, ["n_name"], not_found="fail")


@query("D-J1", sql="""
SELECT b.size, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem JOIN (SELECT DISTINCT p_size AS size FROM part) b
ON l_extendedprice >= b.size * 2000.0 AND l_extendedprice < (b.size + 1) * 2000.0 GROUP BY b.size""")
def range_join_bands(t):
    bands = t.part.select(F.col("p_size").alias("size")).distinct().select("size", (F.col("size") * 2000.0).alias("lo"), ((F.col("size") + 1) * 2000.0).alias("hi"))
    j = joins.range_join(t.lineitem.select("l_extendedprice", "l_quantity"), bands, point="l_extendedprice", low="lo", high="hi", width=2000.0)
    return j.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@query("D-J1", sql="""
SELECT e.event_id AS error_id, COUNT(*) AS events_within_6h FROM events e JOIN events x ON x.user_id = e.user_id AND x.ts >= e.ts AND x.ts < e.ts + INTERVAL 6 HOUR
WHERE e.event_type = 'error' GROUP BY 1""")
def range_join_per_user(t):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000)
    points = t.events.select("user_id", sec.alias("at"))
    spans = t.events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), sec.alias("lo"), (sec + 21600).alias("hi"))
    j = joins.range_join(points, spans, point="at", low="lo", high="hi", width=21600, on=["user_id"])
    return j.groupBy("error_id").agg(F.count(F.lit(1)).alias("events_within_6h"))


SPANS = "(SELECT event_id, user_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + CASE WHEN event_id % 97 = 0 THEN 1000000 ELSE 600 + event_id % 7200 END AS hi FROM events WHERE event_type = '{0}')"


def _spans(t, kind, names):
    lo = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    hi = lo + F.when(F.col("event_id") % 97 == 0, 1_000_000).otherwise(600 + F.col("event_id") % 7200)
    return t.events.filter(F.col("event_type") == kind).select(F.col("event_id").alias(names[0]), "user_id", lo.alias(names[1]), hi.alias(names[2]))


@query("D-J1", sql=f"""
SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM {SPANS.format('error')} e FULL JOIN {SPANS.format('purchase')} p ON e.user_id = p.user_id AND e.lo < p.hi AND p.lo < e.hi""")
def overlapping_spans_full(t):
    """Errors and purchases of a user whose spans overlap, and those without a partner; some spans are a thousand times as long."""
    j = joins.overlap_join(_spans(t, "error", ("error_id", "a", "b")), _spans(t, "purchase", ("purchase_id", "c", "d")), left_range=("a", "b"), right_range=("c", "d"), width=3600, on=["user_id"], how="full")
    return j.select("error_id", "purchase_id")


@query("D-J1", sql=f"""
SELECT o_orderkey, size FROM orders FULL JOIN (SELECT p_size AS size, min(p_retailprice) * 100 AS lo, min(p_retailprice) * 100 + p_size AS hi FROM part GROUP BY 1) b ON o_totalprice >= lo AND o_totalprice < hi""")
def range_join_full(t):
    """Narrow price bands: most orders have no band and some bands no order; both stay."""
    bands = t.part.groupBy(F.col("p_size").alias("size")).agg((F.min("p_retailprice") * 100).alias("lo")).withColumn("hi", F.col("lo") + F.col("size"))
    return joins.range_join(t.orders.select("o_orderkey", "o_totalprice"), bands, point="o_totalprice", low="lo", high="hi", width=50.0, how="full").select("o_orderkey", "size")


@query("D-J1", sql="""
SELECT c_custkey, c_acctbal FROM customer JOIN (SELECT c_nationkey AS nk, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) / COUNT(*) AS mean FROM customer GROUP BY 1) a
ON c_nationkey = nk AND c_acctbal > mean""")
def theta_join_above_mean(t):
    means = t.customer.groupBy(F.col("c_nationkey").alias("nk")).agg((total("c_acctbal") / F.count(F.lit(1))).alias("mean"))
    return joins.theta_join(t.customer, means, "c_nationkey = nk AND c_acctbal > mean").select("c_custkey", "c_acctbal")


@query("D-J2", sql="""
SELECT a.conv_id, a.turn, a.role AS role, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def self_join_next_turn(t):
    c = t.conversations.select("conv_id", "turn", "role")
    return joins.self_join(c, "a.conv_id = b.conv_id AND b.turn = a.turn + 1").select("a.conv_id", "a.turn", F.col("a.role").alias("role"), F.col("b.role").alias("next_role"))


@query("D-J3", sql=f"""
SELECT r_name, n_name, {sql_total('o_totalprice')} AS spend FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def join_four_tables(t):
    j = joins.join_many(t.orders.select("o_custkey", "o_totalprice"), [
        (t.customer.select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")]),
        (t.nation, [("c_nationkey", "n_nationkey")]), (t.region, [("n_regionkey", "r_regionkey")])])
    return j.groupBy("r_name", "n_name").agg(total("o_totalprice").alias("spend"))


ZIP = "SELECT coalesce(a.rn, b.rn) AS row_no, c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer) a {how} JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) b ON a.rn = b.rn"


@query("D-J5", sql=ZIP.format(how=""))
def zip_truncate(t):
    out = joins.zip_rows(t.customer, t.supplier, left_order=["c_acctbal", "c_custkey"], right_order=["s_acctbal", "s_suppkey"])
    return out.select(F.col("row_no").cast("bigint").alias("row_no"), "c_custkey", "s_suppkey")


@query("D-J5", sql=ZIP.format(how="FULL"))
def zip_pad(t):
    out = joins.zip_rows(t.customer, t.supplier, left_order=["c_acctbal", "c_custkey"], right_order=["s_acctbal", "s_suppkey"], policy="pad")
    return out.select(F.col("row_no").cast("bigint").alias("row_no"), "c_custkey", "s_suppkey")


@query("D-J6", sql="""
SELECT a.event_type AS event_type, a.n AS n, b.n AS right_n FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) a
JOIN (SELECT event_type, COUNT(DISTINCT user_id) AS n FROM events GROUP BY 1) b USING (event_type)""")
def join_name_conflict(t):
    a = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    b = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return joins.join(a, b, ["event_type"], conflict="prefix")


@query("D-J6", sql="""
SELECT a.event_type AS event_type, a.n AS left_n, b.n AS n FROM (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) a
JOIN (SELECT event_type, COUNT(DISTINCT user_id) AS n FROM events GROUP BY 1) b USING (event_type)""")
def join_conflict_prefix_left(t):
    a = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    b = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return joins.join(a, b, ["event_type"], conflict="prefix_left", prefix="left_")


@query("D-J6", "J1", sql="""
SELECT a.o_orderkey AS o_orderkey, a.o_custkey AS o_custkey, a.o_orderdate AS o_orderdate, b.o_orderkey AS later_order, b.o_orderdate AS later_date FROM orders a
LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_totalprice > 2 * a.o_totalprice""")
def join_renamed_with_condition(t):
    """Manual names for the right side and a condition beside the keys; orders without such a later one stay."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = joins.join(o, o, ["o_custkey"], "left", conflict="rename", renames={"o_orderkey": "later_order", "o_orderdate": "later_date", "o_totalprice": "later_price"},
                     condition="later_date > o_orderdate AND later_price > 2 * o_totalprice")
    return out.select("o_orderkey", "o_custkey", "o_orderdate", "later_order", "later_date")


TYPOS = "(SELECT DISTINCT translate(p_name, 'oi', '01') AS value FROM part) v, (SELECT DISTINCT p_name AS match FROM part) m"


def _typos(t):
    return t.part.select(F.translate("p_name", "oi", "01").alias("typed"))


@query("D-V2", sql=f"SELECT value, match, levenshtein(value, match) AS distance FROM {TYPOS} WHERE levenshtein(value, match) <= 2")
def fuzzy_levenshtein(t):
    out = joins.levenshtein_match(_typos(t), t.part, column="typed", ref_column="p_name", max_distance=2)
    return out.withColumn("distance", F.col("distance").cast("bigint"))


GRAMS = "list_distinct(list_transform(range(1, greatest(length({c}) - 2, 1) + 1), lambda i: substring(lower({c}), i, 3)))"


@query("D-V2", sql=f"""
SELECT value, match, len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) AS similarity
FROM (SELECT value, match, {GRAMS.format(c='value')} AS ga, {GRAMS.format(c='match')} AS gb FROM {TYPOS})
WHERE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) >= 0.4""")
def fuzzy_ngram(t):
    return joins.ngram_match(_typos(t), t.part, column="typed", ref_column="p_name", threshold=0.4)


@query("D-V2", sql=f"SELECT value, match, {sql_soundex('value')} AS code FROM {TYPOS} WHERE {sql_soundex('value')} = {sql_soundex('match')}")
def fuzzy_soundex(t):
    return joins.soundex_match(_typos(t), t.part, column="typed", ref_column="p_name")


BEST = """SELECT value, match, score FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, match) AS rn FROM (
  SELECT value, match, 1 - levenshtein(value, match) / greatest(length(value), length(match)) AS score FROM {pairs} WHERE {block}) WHERE score >= {t} - 1e-9) WHERE rn = 1"""


@query("D-V2", sql=BEST.format(pairs=TYPOS, block="true", t=0.7))
def fuzzy_best(t):
    """The closest part name of each misspelt one, from a score of 0.7 on."""
    return joins.best_match(_typos(t), t.part, column="typed", ref_column="p_name", threshold=0.7)


@query("D-V2", sql=BEST.format(pairs=TYPOS, block=f"{sql_soundex('value')} = {sql_soundex('match')}", t=0.6))
def fuzzy_soundex_best(t):
    return joins.best_match(_typos(t), t.part, column="typed", ref_column="p_name", threshold=0.6, phonetic=True)
