"""Streams restarted, replayed and compared with batch results."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.aggregates import latest_per_key
from millrace.operators.merge import upsert
from millrace.session import scratch_path
from millrace.streaming import streams


def parts(spark, t, n=4):
    path = scratch_path(spark, "events")
    t.events.repartitionByRange(n, "ts").write.parquet(path)
    return path


def test_several_batches_equal_one(spark, t, rows_of):
    src = streams.read_stream(spark, parts(spark, t), t.events.schema, max_files=1)
    out = streams.run_to_table(src.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), mode="complete")
    assert rows_of(out) == rows_of(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


def test_restart_reads_only_new_files(spark, t):
    path, out, mark = parts(spark, t), scratch_path(spark, "out"), scratch_path(spark, "mark")
    run = lambda: streams.start(streams.read_stream(spark, path, t.events.schema), out, checkpoint=mark, available_now=True).awaitTermination()
    run(), run()
    assert spark.read.parquet(out).count() == t.events.count()
    t.events.limit(10).write.mode("append").parquet(path)
    run()
    assert spark.read.parquet(out).count() == t.events.count() + 10


def test_upsert_over_batches_and_replay(spark, t, rows_of):
    table = streams.VersionedTable(spark, scratch_path(spark, "table"))
    cols = ["user_id", "event_id", "value", "ts"]
    table.write(t.events.select(*cols).limit(0), 0)
    merge = lambda now, batch: upsert(now, latest_per_key(now.unionByName(batch.select(*cols)), ["user_id"], ["ts", "event_id"]), ["user_id"])
    streams.stream_upsert(streams.read_stream(spark, parts(spark, t), t.events.schema, max_files=1), table, merge).awaitTermination()
    want = rows_of(latest_per_key(t.events.select(*cols), ["user_id"], ["ts", "event_id"]))
    assert rows_of(table.read()) == want and table.version() == 4
    table.write(merge(table.at(3), t.events.filter("ts >= timestamp_ntz'2024-01-25'")), 4)      # a replayed batch
    assert table.version() == 4 and rows_of(table.read()) == want


def test_upserts_of_streams_in_a_row_and_replays(spark, t, rows_of):
    table = streams.VersionedTable(spark, scratch_path(spark, "table"))
    cols = ["user_id", "event_id", "value", "ts"]
    rows = t.events.select(*cols)
    table.write(rows.limit(0), 0)
    merge = lambda now, batch: upsert(now, latest_per_key(now.unionByName(batch.select(*cols)), ["user_id"], ["ts", "event_id"]), ["user_id"])
    early, late = t.events.filter("ts < timestamp_ntz'2024-01-15'"), t.events.filter("ts >= timestamp_ntz'2024-01-15'")
    marks = [scratch_path(spark, "mark") for _ in range(2)]
    for part, mark in ((late, marks[0]), (early, marks[1])):
        path = scratch_path(spark, "source")
        part.repartition(2).write.parquet(path)
        run = lambda: streams.stream_upsert(streams.read_stream(spark, path, t.events.schema, max_files=1), table, merge, checkpoint=mark).awaitTermination()
        run(), run()                    # a restart from the same checkpoint adds nothing
    assert rows_of(table.read()) == rows_of(latest_per_key(rows, ["user_id"], ["ts", "event_id"])) and table.version() == 4
    assert table.holds(marks[0], 0) and table.holds(marks[1], 1) and not table.holds(marks[1], 2)


COLS = ["user_id", "event_id", "value", "ts"]


def newest(now, batch):
    return upsert(now, latest_per_key(now.unionByName(batch.select(*COLS)), ["user_id"], ["ts", "event_id"]), ["user_id"])


def test_keyed_batch_rewrites_only_its_buckets(spark, t, rows_of):
    rows = latest_per_key(t.events.select(*COLS), ["user_id"], ["ts", "event_id"]).select(*COLS)
    table = streams.KeyedTable.create(rows, scratch_path(spark, "keyed"), ["user_id"], buckets=64)
    few = rows.orderBy("user_id").limit(2).withColumn("value", F.lit(-1.0)).withColumn("event_id", F.col("event_id") + 10 ** 6)
    touched = {r[0] for r in few.select(table.bucket()).collect()}
    before = {r["bucket"]: r["written"] for r in table.manifest(0).collect()}
    table.upsert(newest, few)
    after = {r["bucket"]: r["written"] for r in table.manifest(1).collect()}
    assert {b for b, v in after.items() if v == 1} == touched and len(touched) <= 2 < len(before)
    assert {b: v for b, v in after.items() if b not in touched} == {b: v for b, v in before.items() if b not in touched}
    assert rows_of(table.read()) == rows_of(newest(rows, few)) and rows_of(table.at(0)) == rows_of(rows)
    assert {p.rsplit("=", 1)[1] for p in table.unused(1)} == {str(b) for b in touched} and table.unused(2) == []


def test_keyed_streams_restart_and_replay(spark, t, rows_of):
    rows = t.events.select(*COLS)
    table = streams.KeyedTable.create(rows.limit(0), scratch_path(spark, "keyed"), ["user_id"], buckets=16)
    assert rows_of(table.read()) == [] and table.read().schema == rows.schema
    early, late = t.events.filter("ts < timestamp_ntz'2024-01-15'"), t.events.filter("ts >= timestamp_ntz'2024-01-15'")
    marks = [scratch_path(spark, "mark") for _ in range(2)]
    for part, mark in ((late, marks[0]), (early, marks[1])):
        path = scratch_path(spark, "source")
        part.repartition(2).write.parquet(path)
        run = lambda: streams.stream_upsert(streams.read_stream(spark, path, t.events.schema, max_files=1), table, newest, checkpoint=mark).awaitTermination()
        run(), run()
    want = rows_of(latest_per_key(rows, ["user_id"], ["ts", "event_id"]))
    assert rows_of(table.read()) == want and table.version() == 4 and table.holds(marks[1], 1)
    again = streams.KeyedTable(spark, table.path)               # opened anew from its folder
    again._commit(newest(again.at(3), late), 4, None, again.manifest(3).limit(0), "s", 7)     # a commit that was cut off is written again
    assert rows_of(again.read()) == want


def test_keyed_emptied_buckets_empty_batches_and_strays(spark, t, rows_of):
    rows = latest_per_key(t.events.select(*COLS), ["user_id"], ["ts", "event_id"]).select(*COLS)
    table = streams.KeyedTable.create(rows, scratch_path(spark, "keyed"), ["user_id"], buckets=8)
    table.upsert(newest, rows.limit(0))
    assert table.version() == 1 and rows_of(table.read()) == rows_of(rows)
    table.upsert(lambda now, batch: now.join(batch, "user_id", "left_anti").select(*COLS), rows)
    assert table.version() == 2 and table.read().count() == 0 and table.manifest(2).count() == 0
    table.upsert(newest, rows)
    assert rows_of(table.read()) == rows_of(rows) == rows_of(table.at(1))
    one = rows.orderBy("user_id").limit(1)
    with pytest.raises(Exception, match="not in the batch's buckets"):
        table.upsert(lambda now, batch: rows, one)
    assert table.version() == 3 and rows_of(table.read()) == rows_of(rows)
    with pytest.raises(ValueError):
        streams.KeyedTable.create(rows, scratch_path(spark, "keyed"), ["nowhere"])


def test_watermark_needs_a_timestamp(spark, t):
    src = streams.event_time(streams.read_stream(spark, parts(spark, t, 1), t.events.schema), "ts", "1 hour")
    assert dict(src.dtypes)["ts"] == "timestamp" and src.isStreaming
