"""Sources and sinks: whole tables written to the shared folder and read back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.plans.registry import day, query, sql_day
from millrace.session import scratch_path
from millrace.sinks import files as sink
from millrace.sinks import mapping
from millrace.sinks import tables as table_sink
from millrace.sources import files as source
from millrace.sources import incremental, kafka
from millrace.sources.tables import read_table

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("S1", "K1", sql="SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber)::BIGINT AS s FROM lineitem WHERE l_returnflag != 'N' GROUP BY 1")
def parquet_partitioned(t):
    """Partitioned write with a salt against large values; the read prunes to two partitions."""
    path = scratch_path(t.spark, "lineitem")
    sink.write_file(t.lineitem, path, "parquet", "overwrite", partition_by=["l_returnflag"], salt=4, compression="zstd")
    return source.read_file(t.spark, path).filter("l_returnflag != 'N'").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))


@query("S1", "K1", sql="SELECT l_orderkey, l_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM lineitem")
def orc_round_trip(t):
    path = scratch_path(t.spark, "orc")
    sink.write_file(t.lineitem.select("l_orderkey", "l_quantity", day("l_shipdate").alias("shipped")), path, "orc", "overwrite", compression="zlib", num_partitions=4)
    return source.read_file(t.spark, path, "orc")


@query("S1", "S2", "S4", "K1", sql=CUSTOMER)
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    sink.write_file(t.customer, path, "csv", "error", compression="gzip", delimiter="|")
    return source.read_file(t.spark, path, "csv", schema=CUSTOMER_SCHEMA, connector={"delimiter": "|", "encoding": "UTF-8", "null_value": "NULL", "corrupt_record_mode": "FAILFAST"})


@query("S1", "S3", "K1", sql=CUSTOMER)
def json_round_trip(t):
    path = scratch_path(t.spark, "json")
    sink.write_file(t.customer, path, "json", "overwrite", compression="gzip")
    return source.read_json(t.spark, path, schema=CUSTOMER_SCHEMA)


@query("S1", sql="SELECT page_id, url, md5(html) AS html FROM pages")
def json_inferred_html(t):
    """Whole page texts with markup and accents survive JSON; the schema is inferred."""
    path = scratch_path(t.spark, "pages")
    sink.write_file(t.pages, path, "json", "overwrite")
    return source.read_file(t.spark, path, "json").select("page_id", "url", F.md5("html").alias("html"))


@query("S18", "K1", sql="SELECT p_partkey, p_name, p_size FROM part")
def xml_round_trip(t):
    path = scratch_path(t.spark, "xml")
    sink.write_file(t.part.select("p_partkey", "p_name", "p_size"), path, "xml", "overwrite", options={"rowTag": "part", "rootTag": "parts"})
    return source.read_file(t.spark, path, "xml", schema="p_partkey BIGINT, p_name STRING, p_size INT", connector={"row_tag": "part"})


@query("S19", sql="SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def fixed_width_read(t):
    path = scratch_path(t.spark, "fixed")
    line = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.rpad("o_orderstatus", 3, " "), F.lpad(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), 16, " "), F.rpad("o_orderpriority", 16, " "))
    sink.write_file(t.orders.select(line.alias("value")), path, "text", "overwrite")
    return source.read_fixed_width(t.spark, path, [("o_orderkey", 12, "bigint"), ("o_orderstatus", 3, "string"), ("o_totalprice", 16, "double"), ("o_orderpriority", 16)])


@query("S4", sql="SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_skipping_preamble(t):
    """Comment lines among the data are dropped by a predicate before parsing."""
    path = scratch_path(t.spark, "preamble")
    lines = t.supplier.select(F.to_csv(F.struct("s_suppkey", "s_name", "s_acctbal")).alias("value"))
    noise = t.nation.select(F.concat(F.lit("# "), "n_name").alias("value"))
    sink.write_file(lines.unionAll(noise), path, "text", "overwrite")
    return source.read_csv_skipping(t.spark, path, "s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE", drop_lines="value LIKE '#%'")


@query("S5", sql=f"SELECT o_orderkey, {sql_day('o_orderdate')} AS ordered, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS at FROM orders")
def typed_read_with_formats(t):
    """Dates kept as text with their own formats, parsed after the read."""
    path = scratch_path(t.spark, "typed")
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd-MMM-yyyy").alias("ordered"), F.date_format("o_orderdate", "yyyyMMdd HHmm").alias("at"))
    sink.write_file(text, path, "csv", "overwrite")
    fields = [{"name": "o_orderkey", "type": "bigint"}, {"name": "ordered", "type": "date", "parseFormat": "dd-MMM-yyyy"}, {"name": "at", "type": "timestamp", "parseFormat": "yyyyMMdd HHmm"}]
    out = source.read_file(t.spark, path, "csv", fields=fields)
    return out.select("o_orderkey", day("ordered").alias("ordered"), F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"))


@query("S6", sql="SELECT CAST(year(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1999 GROUP BY 1")
def date_token_paths(t):
    """Folders such as y_1998_q1; the token pattern reads those of the nineties."""
    base = scratch_path(t.spark, "tokens")
    df = t.orders.withColumn("part", F.concat(F.lit("y_"), F.year("o_orderdate").cast("string"), F.lit("_q"), F.quarter("o_orderdate").cast("string")))
    sink.write_file(df, base, "parquet", "overwrite", partition_by=["part"], salt=2)
    out = source.read_file(t.spark, base + "/part=y_19{YY}_q{Q}")
    return out.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("S9", "K9", sql="SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def catalogue_table(t):
    path = scratch_path(t.spark, "orders")
    name = "orders_" + path.rsplit("-", 1)[1]
    table_sink.write_table(t.orders, name, "overwrite", partition_by=["o_orderstatus"], path=path)
    return read_table(t.spark, name, "o_orderstatus IN ('F', 'P')").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("K9", "T27", sql="SELECT o_orderkey, COUNT(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def bucketed_tables(t):
    """Both sides bucketed by the order key: joining and grouping need no further shuffle."""
    a, b = scratch_path(t.spark, "bo"), scratch_path(t.spark, "bl")
    na, nb = "bo_" + a.rsplit("-", 1)[1], "bl_" + b.rsplit("-", 1)[1]
    table_sink.write_table(t.orders.select("o_orderkey"), na, bucket_by=(8, ["o_orderkey"]), path=a)
    table_sink.write_table(t.lineitem.select("l_orderkey"), nb, bucket_by=(8, ["l_orderkey"]), path=b)
    j = t.spark.table(na).join(t.spark.table(nb), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


@query("K1", "D-INC3", sql="SELECT p, COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, o_orderstatus AS p FROM orders WHERE o_orderstatus != 'P' UNION ALL SELECT c_custkey, 'P' FROM customer) GROUP BY 1")
def dynamic_partition_overwrite(t):
    """The second write replaces only the partition it holds."""
    path = scratch_path(t.spark, "dynamic")
    sink.write_file(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("p")), path, "parquet", "overwrite", partition_by=["p"])
    replacement = t.customer.select(F.col("c_custkey").alias("o_orderkey"), F.lit("P").alias("p"))
    sink.write_file(replacement, path, "parquet", "overwrite", partition_by=["p"], dynamic_overwrite=True)
    return source.read_file(t.spark, path).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("K1", "S1", "D-INC3", sql="SELECT c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def append_with_new_column(t):
    path = scratch_path(t.spark, "evolve")
    sink.write_file(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), path, "parquet", "append")
    sink.write_file(t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("segment")), path, "parquet", "append")
    return source.read_file(t.spark, path, merge_schema=True)


@query("K1", sql="SELECT n_nationkey, n_name FROM nation")
def ignore_mode_keeps_first(t):
    path = scratch_path(t.spark, "ignore")
    sink.write_file(t.nation.select("n_nationkey", "n_name"), path, "parquet", "ignore")
    sink.write_file(t.region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), path, "parquet", "ignore")
    return source.read_file(t.spark, path)


@query("K11", sql="SELECT COUNT(*) AS n FROM lineitem")
def noop_sink(t):
    sink.discard(t.lineitem)
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("K12", "K13", "K16", sql="SELECT c_custkey AS id, c_name AS \"fullName\", 'r-9' AS run, 'loader' AS by_user, true AS dated FROM customer")
def mapped_target(t):
    auto = mapping.auto_map(["C_CUSTKEY"], ["c_custkey"])
    entries = [{"src": auto[0]["src"], "tgt": "id"}, {"src": "c_name", "tgt": "fullName"}, {"src": "", "tgt": "skipped"}, {"src": "__audit__:run_id", "tgt": "run"}, {"src": "__audit__:user_name", "tgt": "by_user"},
               {"src": "__audit__:current_date", "tgt": "d"}, {"src": "__audit__:current_time", "tgt": "tm"}, {"src": "__audit__:job_name", "tgt": "job"}, {"src": "__audit__:current_timestamp", "tgt": "ts"}]
    out = mapping.map_columns(t.customer, entries, run_id="r-9", user="loader", job="nightly")
    return out.select("id", "fullName", "run", "by_user", ((F.to_date("ts") == F.col("d")) & F.col("tm").rlike("^..:..:..$") & (F.col("job") == "nightly")).alias("dated"))


@query("K15", sql="""
SELECT 'kept' AS policy, o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders UNION ALL SELECT 'rejected', o_orderkey, nullif(o_orderpriority, '5-LOW') FROM orders WHERE o_orderpriority != '5-LOW'
UNION ALL SELECT 'defaulted', o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'n/a') FROM orders""")
def sink_null_policies(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    parts = {"kept": mapping.null_policy(df, "KEEP"), "rejected": mapping.null_policy(df, "REJECT", keys=["p"]), "defaulted": mapping.null_policy(df, "DEFAULT", defaults={"p": "n/a"})}
    tagged = [p.select(F.lit(n).alias("policy"), "o_orderkey", "p") for n, p in parts.items()]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2])


def _records(t):
    """Event rows in the shape of a message log."""
    encoded = table_sink.encode_kafka(t.events.select("event_id", "user_id", "event_type", "value"), key="user_id")
    return encoded.select(F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), F.lit("events").alias("topic"), F.pmod(F.hash("key"), F.lit(4)).alias("partition"),
                          F.get_json_object("value", "$.event_id").cast("bigint").alias("offset"), F.current_timestamp().alias("timestamp"))


@query("K8", "S14", sql="SELECT event_id, user_id, event_type, value, CAST(user_id AS VARCHAR) AS _kafka_key, 'events' AS _kafka_topic, event_id AS _kafka_offset FROM events")
def message_json_round_trip(t):
    out = kafka.decode_json(_records(t), "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE")
    return out.drop("_kafka_partition", "_kafka_timestamp")


@query("S15", sql="""SELECT CAST(user_id AS VARCHAR) AS _kafka_key, event_id AS _kafka_offset, event_type FROM events""")
def message_text(t):
    out = kafka.decode_text(_records(t))
    return out.select("_kafka_key", "_kafka_offset", F.get_json_object("value", "$.event_type").alias("event_type"))


@query("D-INC1", sql="SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-19 22:00:00'")
def incremental_with_look_back(t):
    """The mark is stored after a first load, read again, and applied with two hours of look-back."""
    path = scratch_path(t.spark, "marks")
    first = t.events.filter("ts <= timestamp_ntz'2024-01-20'")
    incremental.save_watermark(incremental.next_watermark(first, "ts", "events"), path)
    stored = incremental.load_watermark(t.spark, path, "events")
    mark = datetime.fromisoformat(stored).replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)
    return incremental.above_watermark(t.events, "ts", mark, look_back=timedelta(hours=2)).select("event_id")


@query("D-INC1", sql="SELECT o_orderkey FROM orders WHERE o_orderkey > 100")
def incremental_initial_value(t):
    return incremental.above_watermark(t.orders, "o_orderkey", None, initial=100).select("o_orderkey")


@query("D-INC2", sql="SELECT d, COUNT(*) AS n FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events) WHERE d > '2024-01-20' GROUP BY 1")
def incremental_partitions(t):
    path = scratch_path(t.spark, "days")
    sink.write_file(t.events.withColumn("d", day("ts")), path, "parquet", "overwrite", partition_by=["d"], num_partitions=8)
    stored = t.spark.read.option("inferSchema", False).schema(t.events.withColumn("d", day("ts")).schema).parquet(path)
    return incremental.partitions_since(stored, "d", "2024-01-20").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
