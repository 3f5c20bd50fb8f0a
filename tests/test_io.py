"""Options, paths, schemas, policies and round trips. Connectors without a jar are tested by their options."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialise, scratch_path, shared_dir
from millrace.sinks import files as sink
from millrace.sinks import mapping
from millrace.sinks import tables as table_sink
from millrace.sources import files, incremental, jdbc, kafka, schemas, tables
from millrace.sources.paths import path_glob


@pytest.mark.parametrize("path, want", [
    ("/d/{YYYYMMDD}/x.csv", "/d/????????/x.csv"), ("/d/{DD-MON-YYYY}", "/d/??-???-????"), ("f_{YYYY-MM-DD_HH24MISS}.json", "f_????-??-??_??????.json"),
    ("f_{HH24MISSFF3}", "f_?????????"), ("f_{MONTH}", "f_*"), ("f_{BATCH}", "f_*"), ("f_{}", "f_*"), ("plain", "plain"), ("{Q}/{YY}", "?/??"),
])
def test_path_tokens(path, want):
    assert path_glob(path) == want


@pytest.mark.parametrize("text, want", [
    ("numeric(12,4)", T.DecimalType(12, 4)), ("decimal", T.DecimalType(18, 2)), ("bigint", T.LongType()), ("int8", T.LongType()), ("integer", T.IntegerType()), ("smallint", T.IntegerType()),
    ("double precision", T.DoubleType()), ("real", T.FloatType()), ("timestamptz", T.TimestampType()), ("timestamp without time zone", T.TimestampType()), ("bool", T.BooleanType()), ("date", T.DateType()),
    ("bytea", T.BinaryType()), ("varchar(20)", T.StringType()), ("", T.StringType()), (None, T.StringType()), ({"name": "decimal"}, T.DecimalType(10, 2)),
    ({"name": "array", "elementType": "long"}, T.ArrayType(T.LongType())), ({"name": "map", "valueType": {"name": "double"}}, T.MapType(T.StringType(), T.DoubleType())),
    ({"name": "struct", "fields": [{"name": "a", "type": "int"}]}, T.StructType([T.StructField("a", T.IntegerType())])),
])
def test_catalogue_types(text, want):
    assert schemas.data_type(text) == want


def test_tolerant_and_strict_date_formats(spark):
    fields = [{"name": "d", "type": "date", "parseFormat": "dd/MM/yyyy"}]
    df = spark.createDataFrame([("01/02/2024",), ("oops",)], schemas.read_schema(fields))
    assert [r["d"] for r in schemas.parse_formatted(df, fields, tolerant=True).collect()] == [date(2024, 2, 1), None]
    with pytest.raises(Exception):
        schemas.parse_formatted(df, fields).collect()


def test_connector_options_skip_unset_values():
    assert files.connector_options({"encoding": "ISO-8859-1", "null_value": "", "quote": None, "header": False, "unknown": 1}) == {"encoding": "ISO-8859-1", "header": "false"}


def test_csv_is_strict_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\nx,3\n")
    with pytest.raises(Exception):
        files.read_file(spark, str(tmp_path), "csv", schema="k INT, v INT").collect()
    got = files.read_file(spark, str(tmp_path), "csv", schema="k INT, v INT", connector={"corrupt_record_mode": "PERMISSIVE"})
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 2), (None, 3)]


def test_multi_line_json_glob_filter_and_recursion(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "sub" / "b.txt").write_text("not json")
    df = files.read_file(spark, str(tmp_path), "json", schema="a INT", recursive=True, path_glob_filter="*.json", options={"multiLine": True})
    assert sorted(r["a"] for r in df.collect()) == [1, 2]
    assert files.read_file(spark, str(tmp_path), "json", schema="a INT", recursive=True, path_glob_filter="*.json", modified_after="2999-01-01T00:00:00", options={"multiLine": True}).count() == 0


def test_infer_schema_and_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tv\n1\t2.5\n")
    assert files.read_file(spark, str(tmp_path), "tsv", infer_schema=True).dtypes == [("k", "int"), ("v", "double")]


# ------------------------------------------------------------------ JDBC, Delta, Iceberg, Kafka


def test_jdbc_options():
    o = jdbc.jdbc_options("jdbc:postgresql://h:5432/d", query="SELECT 1;", num_partitions=4, partition_column="id", lower_bound=1, upper_bound=9)
    assert o["dbtable"] == "(SELECT 1) q" and o["driver"] == "org.postgresql.Driver" and o["numPartitions"] == "4" and o["pushDownPredicate"] == "true"
    assert jdbc.jdbc_options("jdbc:x:", table="t", mode="INCREMENTAL", watermark=("ts", "it's"))["dbtable"] == "(SELECT * FROM t WHERE ts > 'it''s') w"
    for bad in (dict(), dict(table="t", query="q"), dict(table="t", partition_column="id"), dict(table="t", mode="CUSTOM_QUERY")):
        with pytest.raises(ValueError):
            jdbc.jdbc_options("jdbc:x:", **bad)


@pytest.mark.parametrize("vendor", jdbc.VENDORS)
def test_vendor_urls_find_their_driver(vendor):
    assert jdbc.driver_for(jdbc.jdbc_url(vendor, "host", "db")) == jdbc.VENDORS[vendor][1]


def test_table_format_options():
    assert tables.delta_options(version=3) == {"versionAsOf": "3"}
    assert tables.delta_options(change_feed=True, starting_version=0) == {"readChangeFeed": "true", "startingVersion": "0"}
    assert tables.iceberg_options(snapshot_id=7) == {"snapshot-id": "7"} and tables.iceberg_options(as_of_timestamp=5) == {"as-of-timestamp": "5"}
    for bad in (lambda: tables.delta_options(version=1, timestamp="t"), lambda: tables.delta_options(change_feed=True), lambda: tables.iceberg_options(snapshot_id=1, as_of_timestamp=1)):
        with pytest.raises(ValueError):
            bad()
    assert table_sink.merge_condition(["a", "b"]) == "target.`a` = source.`a` AND target.`b` = source.`b`"
    assert table_sink.jdbc_write_options("jdbc:mysql://h/d", "t", truncate=True, create_options="ENGINE=InnoDB") == {
        "url": "jdbc:mysql://h/d", "dbtable": "t", "batchsize": "10000", "truncate": "true", "driver": "com.mysql.cj.jdbc.Driver", "createTableOptions": "ENGINE=InnoDB"}


def test_partition_transforms(spark):
    made = table_sink.partition_transforms([("identity", "a"), ("year", "b"), ("month", "b"), ("day", "b"), ("hour", "b"), ("bucket", "c", 16)])
    assert len(made) == 6


def test_kafka_options_and_decoding(spark):
    assert kafka.kafka_options("h:1", "t")["endingOffsets"] == "latest" and kafka.kafka_options("h:1", "t")["startingOffsets"] == "earliest"
    assert "endingOffsets" not in kafka.kafka_options("h:1", "t", streaming=True, group_id="g")
    df = spark.createDataFrame([(b"k", b'{"a": 1}', "t", 0, 5), (None, b"broken", "t", 0, 6)], "key binary, value binary, topic string, partition int, offset bigint").withColumn("timestamp", F.current_timestamp())
    rows = kafka.decode_json(df, "a INT").orderBy("_kafka_offset").collect()
    assert [(r["a"], r["_kafka_key"]) for r in rows] == [(1, "k"), (None, None)]
    assert kafka.decode_json(df, "a INT", watermark="1 minute").columns[-1] == "_kafka_timestamp"
    nulls = table_sink.encode_kafka(spark.createDataFrame([(1, None)], "a int, b string"), "a").first()
    assert tuple(nulls) == ("1", '{"a":1,"b":null}')


# ------------------------------------------------------------------ sinks


def test_merge_never_becomes_overwrite(t):
    for mode in ("merge", "MERGE", "upsert"):
        with pytest.raises(ValueError):
            sink.write_file(t.nation, "/nowhere", mode=mode)
    with pytest.raises(ValueError):
        sink.write_file(t.nation, "/nowhere", "csv", compression="zlib")


def test_error_mode_and_codecs(spark, t):
    path = scratch_path(spark, "codec")
    sink.write_file(t.nation, path, compression="gzip")
    with pytest.raises(Exception):
        sink.write_file(t.nation, path)
    for fmt, codec in (("parquet", "snappy"), ("parquet", "zstd"), ("orc", "snappy"), ("csv", "bzip2"), ("json", "deflate")):
        out = scratch_path(spark, "codec")
        sink.write_file(t.region, out, fmt, compression=codec)
        assert files.read_file(spark, out, fmt, schema=t.region.schema).count() == 5


def test_mapping_rules(t):
    assert mapping.map_columns(t.region, []).columns == t.region.columns
    assert mapping.map_columns(t.region, '[{"src": "r_name", "tgt": "n"}, {"src": "r_name"}]').columns == ["n"]
    with pytest.raises(ValueError):
        mapping.map_columns(t.region, [{"src": "__audit__:nonsense", "tgt": "x"}])
    assert mapping.auto_map(["A", "b"], ["a", "B", "c"]) == [{"src": "A", "tgt": "a"}, {"src": "b", "tgt": "B"}]
    assert mapping.auto_map(["A", "b"], ["a", "b"], case_sensitive=True) == [{"src": "b", "tgt": "b"}]
    assert mapping.auto_map(["A", "b"], ["x", "y"], "position") == [{"src": "A", "tgt": "x"}, {"src": "b", "tgt": "y"}]


def test_scratch_folder_follows_the_session(spark, t):
    class Session:
        def __init__(self, value):
            self.conf = {"spark.checkpoint.dir": value}

    assert shared_dir(Session("hdfs://shared/ck/")) == "hdfs://shared/ck"
    assert shared_dir(Session(None)) == shared_dir(Session(None))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert materialise(t.nation).inputFiles()[0].replace("file://", "").startswith(shared_dir(spark))


def test_watermark_without_last_value(t):
    assert incremental.above_watermark(t.orders, "o_orderkey", None).count() == t.orders.count()
    from datetime import datetime
    some = incremental.above_watermark(t.events, "ts", datetime(2024, 1, 20), look_back=timedelta(days=1))
    assert some.count() == t.events.filter("ts > timestamp_ntz'2024-01-19'").count()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in some._jdf.queryExecution().toString()


def test_create_statement_with_truncate_parses(spark):
    df = spark.createDataFrame([], "`a b` string, k bigint, at timestamp")
    text = table_sink.create_statement(df, "cat.db.t", [("truncate", "a b", 4), ("bucket", "k", 16), ("day", "at"), ("identity", "k")])
    assert text.endswith("PARTITIONED BY (truncate(4, `a b`), bucket(16, `k`), days(`at`), `k`)")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    assert "truncate(4, a b)" in plan.replace("`", "")
    with pytest.raises(ValueError):
        table_sink.create_statement(df, "t", [("week", "at")])
