"""Profiles, catalogue comparison, type inference, lineage and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lineage, profile
from millrace.plans.registry import query


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        number, text = kind in ("bigint", "int", "double"), kind == "string"
        parts.append(f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, COUNT(*) AS row_count, COUNT(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / COUNT(*) AS null_pct, COUNT(*) FILTER ({c} IS NULL) AS null_count, COUNT(DISTINCT {c}) AS distinct_count,
          CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value, {f'round(AVG({c}), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS mean_value, {f'round(stddev_samp({c}), 4)' if number else 'CAST(NULL AS DOUBLE)'} AS stddev_value,
          {f'COUNT(*) FILTER ({c} = 0)' if number else 'CAST(0 AS BIGINT)'} AS zero_count, {f'COUNT(*) FILTER ({c} < 0)' if number else 'CAST(0 AS BIGINT)'} AS negative_count, {f"COUNT(*) FILTER (trim({c}) = '')" if text else 'CAST(0 AS BIGINT)'} AS empty_count,
          {f'CAST(MIN(length({c})) AS INTEGER)' if text else 'CAST(NULL AS INTEGER)'} AS min_length, {f'CAST(MAX(length({c})) AS INTEGER)' if text else 'CAST(NULL AS INTEGER)'} AS max_length FROM {table}""")
    return " UNION ALL ".join(parts)


def _rounded(df):
    return df.withColumns({"mean_value": F.round("mean_value", 4), "stddev_value": F.round("stddev_value", 4)})


@query("D-PR1", sql=_profile_sql("(SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "segment": "string"}))
def profile_customer(t):
    df = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING"))).drop("c_mktsegment")
    return _rounded(profile.profile(df, exact_distinct=True))


@query("D-PR1", sql="SELECT column_name, rows AS row_count, true AS distinct_close FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_quantity', 'l_extendedprice']) AS column_name, COUNT(*) AS rows FROM lineitem)")
def profile_with_sketch(t):
    """The sketch stays within three standard errors of the exact counts."""
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    exact = t.lineitem.agg(*[F.count_distinct(c).alias(c) for c in names]).unpivot([], names, "column_name", "exact")
    return profile.profile(t.lineitem, names, rsd=0.02).join(exact, "column_name").select("column_name", "row_count", (F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.06 + 1).alias("distinct_close"))


def _numbers_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, COUNT({c}) AS values_seen, MIN({c})::DOUBLE AS min_value, MAX({c})::DOUBLE AS max_value, round(var_samp({c}), 3) AS variance,
      (SELECT v FROM (SELECT {c}::DOUBLE AS v, COUNT(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS mode,
      {', '.join(f'round(quantile_cont({c}::DOUBLE, {p}), 4) AS {k}' for k, p in profile.PERCENTILES.items())},
      {" || ',' || ".join(f"CAST(COUNT(*) FILTER (least(floor(({c} - lo) / (hi - lo) * 10), 9) = {b}) AS VARCHAR)" for b in range(10))} AS histogram
      FROM {table}, (SELECT MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi FROM {table})""" for c in columns)


@query("D-PR1", sql=_numbers_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]))
def profile_numbers(t):
    """Variance, mode, exact percentiles and ten equal-width bins of four columns."""
    df = profile.number_profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"])
    return df.withColumns({"variance": F.round("variance", 3), "histogram": F.concat_ws(",", F.col("histogram").cast("array<string>")), **{k: F.round(k, 4) for k in profile.PERCENTILES}})


@query("D-PR1", sql="""
WITH c AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'c' || c_custkey || '@example.com' WHEN 1 THEN '+49 30 ' || (100000 + c_custkey) WHEN 2 THEN '1995-03-1' || (c_custkey % 10) WHEN 3 THEN c_name END AS contact, c_name FROM customer)
SELECT column_name, COUNT(v) AS values_seen, round(AVG(length(v)), 6) AS mean_length, COUNT(*) FILTER (v LIKE '%@%') AS email_count, COUNT(*) FILTER (v LIKE '+49%') AS phone_count, COUNT(*) FILTER (v LIKE '1995-%') AS date_count, CAST(0 AS BIGINT) AS uuid_count
FROM (SELECT 'contact' AS column_name, contact AS v FROM c UNION ALL SELECT 'c_name', c_name FROM c) GROUP BY column_name""")
def profile_text_shapes(t):
    k = F.col("c_custkey")
    contact = (F.when(k % 5 == 0, F.concat(F.lit("c"), k, F.lit("@example.com"))).when(k % 5 == 1, F.concat(F.lit("+49 30 "), k + 100000))
               .when(k % 5 == 2, F.concat(F.lit("1995-03-1"), k % 10)).when(k % 5 == 3, F.col("c_name")))
    return profile.text_profile(t.customer.select(contact.alias("contact"), "c_name")).withColumn("mean_length", F.round("mean_length", 6))


def _freq(order: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, value, frequency, position FROM (SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS frequency, row_number() OVER (ORDER BY COUNT(*) {order}, CAST({c} AS VARCHAR)) AS position FROM part GROUP BY 1) WHERE position <= 10"""
                              for c in ("p_brand", "p_type", "p_size"))


@query("D-PR1", sql=_freq("DESC"))
def profile_top_values(t):
    return profile.frequencies(t.part, ["p_brand", "p_type", "p_size"]).withColumn("position", F.col("position").cast("bigint"))


@query("D-PR1", sql=_freq("ASC"))
def profile_bottom_values(t):
    return profile.frequencies(t.part, ["p_brand", "p_type", "p_size"], rarest=True).withColumn("position", F.col("position").cast("bigint"))


@query("D-PR1", sql="SELECT COUNT(*) FILTER (n > 1) AS duplicated_keys, CAST(SUM(n - 1) AS BIGINT) AS surplus_rows FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text)")
def profile_duplicates(t):
    return profile.duplicate_rows(t.documents, ["text"])


@query("D-PR1", "R29", sql="SELECT regexp_replace(regexp_replace(regexp_replace(url, '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '9', 'g') AS shape, COUNT(*) AS frequency FROM pages GROUP BY 1")
def profile_url_shapes(t):
    return profile.pattern_classes(t.pages, "url")


@query("D-PR3", sql="""
SELECT unnest(['k', 'price', 'd', 'flag', 'pri', 'stamp']) AS column_name, COUNT(*) AS values_seen, unnest(['integer', 'decimal', 'date', 'boolean', 'string', 'timestamp']) AS inferred_type FROM orders""")
def infer_text_types(t):
    df = t.orders.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                         (F.col("o_orderstatus") == "F").cast("string").alias("flag"), F.col("o_orderpriority").alias("pri"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return profile.infer_types(df, df.columns)


@query("D-PR3", sql="""
SELECT unnest(['small', 'large', 'huge', 'answer', 'bit']) AS column_name, COUNT(*) AS values_seen, unnest(['integer', 'bigint', 'decimal', 'boolean', 'integer']) AS inferred_type FROM orders""")
def infer_number_ranges(t):
    k = F.col("o_orderkey")
    df = t.orders.select(k.cast("string").alias("small"), (k + 3_000_000_000).cast("string").alias("large"), F.concat(F.lit("9"), F.lpad(k.cast("string"), 20, "0")).alias("huge"),
                         F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("answer"), (k % 2).cast("string").alias("bit"))
    return profile.infer_types(df, df.columns)


LAYOUTS = """(SELECT user_id AS dataset, event_type AS column_name, CASE WHEN MAX(value) >= 100 THEN 'decimal(5,2)' ELSE 'decimal(4,2)' END AS data_type, MIN(value) < 1 AS is_nullable FROM events WHERE ts {when} TIMESTAMP '2024-01-16' GROUP BY 1, 2)"""


@query("D-PR2", sql=f"""
SELECT dataset, column_name, change, old_type, new_type, CASE WHEN change IN ('REMOVED', 'TYPE_CHANGED') OR NOT new_null THEN 'BREAKING' ELSE 'COMPATIBLE' END AS severity FROM (
  SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.column_name, b.column_name) AS column_name, a.data_type AS old_type, b.data_type AS new_type, b.is_nullable AS new_null,
    CASE WHEN a.dataset IS NULL THEN 'ADDED' WHEN b.dataset IS NULL THEN 'REMOVED' WHEN a.data_type != b.data_type THEN 'TYPE_CHANGED' WHEN a.is_nullable != b.is_nullable THEN 'NULLABILITY_CHANGED' END AS change
  FROM {LAYOUTS.format(when='<')} a FULL JOIN {LAYOUTS.format(when='>=')} b ON a.dataset = b.dataset AND a.column_name = b.column_name) WHERE change IS NOT NULL""")
def catalogue_changes(t):
    """Smallest type and optionality each user's event columns need, in two halves of the month."""
    def snapshot(when):
        return t.events.filter(when).groupBy(F.col("user_id").alias("dataset"), F.col("event_type").alias("column_name")).agg(
            F.when(F.max("value") >= 100, "decimal(5,2)").otherwise("decimal(4,2)").alias("data_type"), (F.min("value") < 1).alias("is_nullable"))
    return profile.schema_changes(snapshot("ts < timestamp_ntz'2024-01-16'"), snapshot("ts >= timestamp_ntz'2024-01-16'"))


ACCESS = """(SELECT DISTINCT s_nationkey AS actor, p_type AS dataset, CASE l_returnflag WHEN 'A' THEN 'WRITE' WHEN 'R' THEN 'READ' ELSE 'READ_WRITE' END AS mode FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


@query("D-L1", sql=f"""
SELECT w.actor AS producer, r.actor AS consumer, w.dataset FROM (SELECT DISTINCT actor, dataset FROM {ACCESS} WHERE mode != 'READ') w JOIN (SELECT DISTINCT actor, dataset FROM {ACCESS} WHERE mode != 'WRITE') r ON w.dataset = r.dataset AND w.actor != r.actor""")
def lineage_edges(t):
    """Nations as jobs and part types as datasets; the access map is a distinct over all line items."""
    mode = F.when(F.col("l_returnflag") == "A", "WRITE").when(F.col("l_returnflag") == "R", "READ").otherwise("READ_WRITE")
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    access = j.select(F.col("s_nationkey").alias("actor"), F.col("p_type").alias("dataset"), mode.alias("mode")).distinct()
    return lineage.dataset_edges(access, actor="actor", dataset="dataset", mode="mode")


@query("D-L2", sql="""
SELECT '/' || r_name || '/' || n_name AS path, n_name AS node, 1 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || c_name, c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def hierarchy_descendants(t):
    paths = lineage.materialised_paths([
        (t.region, "r_regionkey", None, "r_name"), (t.nation, "n_nationkey", "n_regionkey", "n_name"), (t.customer, "c_custkey", "c_nationkey", "c_name")])
    return lineage.descendants(paths, "/ASIA")
