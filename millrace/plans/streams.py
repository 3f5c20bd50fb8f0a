"""Structured Streaming over the event files, run to completion and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.aggregates import latest_per_key
from millrace.operators.merge import upsert
from millrace.plans.registry import money, query, sql_total
from millrace.session import scratch_path
from millrace.sources import kafka
from millrace.sinks.tables import encode_kafka
from millrace.streaming import streams


def _stream(t):
    # A pattern matches a single file and a folder of files alike.
    return streams.read_stream(t.spark, t.path("events") + "*", t.events.schema, max_files=64)


@query("ST1", "ST3", "ST7", sql="SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase'")
def stream_filter_append(t):
    """Stateless rows into a file sink, all available data, then stop."""
    return streams.run_to_table(_stream(t).filter("event_type = 'purchase'").select("event_id", "user_id", (F.col("value") * 2).alias("doubled")))


@query("ST4", "ST6", sql=f"SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, {sql_total('value')} AS total FROM events GROUP BY 1, 2")
def stream_tumbling_complete(t):
    df = streams.event_time(_stream(t), "ts", "1 hour")
    out = streams.windowed(df, "ts", "1 day", [F.count(F.lit(1)).alias("n"), F.sum(money("value")).alias("total")], keys=["event_type"])
    return streams.run_to_table(out, mode="complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("ST4", "ST6", sql="""
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, COUNT(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY 1""")
def stream_sliding_complete(t):
    df = streams.event_time(_stream(t), "ts", "1 hour")
    out = streams.windowed(df, "ts", "12 hours", [F.count(F.lit(1)).alias("n")], slide="6 hours")
    return streams.run_to_table(out, mode="complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("ST2", "ST6", sql="""
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY time_bucket(INTERVAL 1 DAY, ts)
HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_append_closed_windows(t):
    """Append mode emits the windows the watermark has passed."""
    df = streams.event_time(_stream(t), "ts", "1 hour")
    out = streams.windowed(df, "ts", "1 day", [F.count(F.lit(1)).alias("n")])
    return streams.run_to_table(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("ST6", sql="SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1")
def stream_update_counts(t):
    """Update mode emits changed groups per micro-batch; the last value of each group counts."""
    out = streams.run_to_table(_stream(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), mode="update")
    return latest_per_key(out, ["user_id"], ["batch"], ["n"])


@query("ST2", sql="SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY 1")
def stream_messages_with_watermark(t):
    """Events in message form: decoded, with the watermark on the message timestamp."""
    s = _stream(t)
    records = encode_kafka(s.select("event_id", "event_type", "ts"), key="event_id").select(
        "key", "value", F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"), F.to_timestamp(F.get_json_object("value", "$.ts")).alias("timestamp"))
    decoded = kafka.decode_json(records, "event_id BIGINT, event_type STRING", watermark="10 minutes")
    out = streams.windowed(decoded, "_kafka_timestamp", "1 day", [F.count(F.lit(1)).alias("n")])
    return streams.run_to_table(out, mode="complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query("ST5", sql="SELECT value > 60 AS is_late, COUNT(*) AS n FROM events GROUP BY 1")
def stream_late_rows_split(t):
    """``value`` stands for the delay in minutes; rows later than an hour go to their own partition."""
    arrival = F.timestamp_add("MINUTE", F.floor(F.col("value")).cast("int"), F.col("ts")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("value") - F.floor("value")) * 60).cast("decimal(18,6)"))
    flagged = streams.flag_late(_stream(t).withColumn("arrived", arrival), "ts", "arrived", "60 MINUTES")
    out = scratch_path(t.spark, "late")
    def split(batch, number):
        batch.select("event_id", "is_late").write.mode("overwrite").partitionBy("is_late").parquet(f"{out}/batch={number}")
    streams.start_foreach(flagged, split, mode="append", available_now=True).awaitTermination()
    return t.spark.read.parquet(out).groupBy(F.col("is_late").cast("boolean").alias("is_late")).agg(F.count(F.lit(1)).alias("n"))


@query("ST8", sql="""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert_latest(t):
    """Each micro-batch is merged into a versioned table; older rows never replace newer ones."""
    table = streams.VersionedTable(t.spark, scratch_path(t.spark, "upsert"))
    columns = ["user_id", "event_id", "event_type", "ts"]
    start = t.events.filter("ts < timestamp_ntz'2024-01-10' AND event_type = 'view'").select(*columns)
    table.write(latest_per_key(start, ["user_id"], ["ts", "event_id"]), 0)
    def merge(current, batch):
        latest = latest_per_key(current.unionByName(batch.select(*columns)), ["user_id"], ["ts", "event_id"])
        return upsert(current, latest, ["user_id"])
    streams.stream_upsert(_stream(t), table, merge).awaitTermination()
    return table.read().select("user_id", "event_id", "event_type")


@query("ST8", sql="""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert_keyed(t):
    """The same upsert into hash buckets: each micro-batch reads and rewrites the buckets of its own users."""
    columns = ["user_id", "event_id", "event_type", "ts"]
    start = t.events.filter("ts < timestamp_ntz'2024-01-10' AND event_type = 'view'").select(*columns)
    table = streams.KeyedTable.create(latest_per_key(start, ["user_id"], ["ts", "event_id"]).select(*columns), scratch_path(t.spark, "keyed"), ["user_id"])
    def merge(current, batch):
        latest = latest_per_key(current.unionByName(batch.select(*columns)), ["user_id"], ["ts", "event_id"])
        return upsert(current, latest, ["user_id"])
    streams.stream_upsert(_stream(t), table, merge).awaitTermination()
    return table.read().select("user_id", "event_id", "event_type")


@query("D-W5", "ST4", sql="""
WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM f)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, no""")
def stream_sessions(t):
    df = streams.event_time(_stream(t), "ts", "1 hour")
    out = streams.sessions(df, "ts", "4 hours", [F.count(F.lit(1)).alias("n")], ["user_id"])
    return streams.run_to_table(out, mode="complete").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
