"""NULLs, empty input, duplicates and algebraic checks on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import aggregates, joins, layout, masking, merge, nested, profile, quality, rows, sets, sizing, udfs
from millrace.operators.aggregates import Agg
from millrace.operators.conditions import Condition, as_condition, case_when, operand
from millrace.operators.ordering import Sort, as_sorts
from millrace.operators.quality import Rule
from millrace.plans import load


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, None, None), (3, "b", -2.5), (4, "a", 0.0), (4, "a", 0.0)], "id int, name string, v double")


def fails(action, text):
    with pytest.raises(Exception) as e:
        action()
    assert text in str(e.value)


# ------------------------------------------------------------------ filters and conditions


def test_include_exclude_and_null_rows_add_up(small):
    cond = "name = 'a'"
    parts = [rows.filter_rows(small, cond), rows.filter_rows(small, cond, "EXCLUDE"), small.filter("name IS NULL")]
    assert sum(p.count() for p in parts) == small.count()
    good, bad = rows.filter_split(small, cond)
    assert good.count() + bad.count() == small.count()


@pytest.mark.parametrize("text", ["", "   ", None, ";", "WHERE", "where ;"])
def test_blank_condition_keeps_all(small, text):
    assert small.filter(as_condition(text)).count() == 5


def test_empty_condition_and_empty_case(small):
    assert small.filter(Condition().to_column()).count() == 5
    assert small.select(case_when([]).alias("x")).filter("x IS NULL").count() == 5


@pytest.mark.parametrize("given, want", [(3, 3), ("3", 3), ("-2.5", -2.5), ("true", True), (None, None), ("NULL", None), ("'it''s'", "it's"), ('"q"', "q"), ("id", 1), ("id + 1", 2), ("", None)])
def test_operands(spark, given, want):
    got = spark.range(1).select(F.lit(1).alias("id")).select(operand(given).alias("x")).first()["x"]
    assert got == want


def test_values_with_wildcards_are_literal(spark):
    from millrace.operators.conditions import Clause
    df = spark.createDataFrame([("50% off",), ("500 off",)], "s string")
    assert df.filter(Clause("s", "contains", "0%").to_column()).count() == 1


# ------------------------------------------------------------------ columns, sorts, dedup


def test_single_derive_keeps_its_type(small):
    assert dict(rows.derive(small, [("x", "id", "string")]).dtypes)["x"] == "string"


def test_nulls_first_keeps_desc(small):
    got = [r["v"] for r in rows.sort(small, Sort("v", "desc", "first")).collect()]
    assert got == [None, 5.0, 0.0, 0.0, -2.5]
    assert [s.nulls_first for s in as_sorts(["a", ("b", "desc"), ("c", "asc", "last")])] == [True, False, False]


def test_dedup_policies(spark):
    df = spark.createDataFrame([(1, 10, "x"), (1, 20, "y"), (2, None, "z"), (None, 5, "n"), (None, 6, "m")], "k int, o int, p string")
    first = {r["k"]: r["p"] for r in rows.dedup(df, ["k"], keep="first", order_by="o").collect()}
    last = {r["k"]: (r["p"], r["c"]) for r in rows.dedup(df, ["k"], keep="last", order_by="o", count_alias="c").collect()}
    assert first == {1: "x", 2: "z", None: "n"} and last == {1: ("y", 2), 2: ("z", 1), None: ("m", 2)}
    assert rows.dedup(df.limit(0), ["k"], keep="first", order_by="o").count() == 0


def test_splits_are_exhaustive_and_stable(t):
    e = t.events
    for split in (rows.random_split(e, [0.5, 0.5], 1), rows.hash_split(e, ["user_id"], [1, 1, 1])):
        assert split.count() == e.count()
    a = rows.random_split(e, [0.5, 0.5], 1).select("event_id", "split")
    assert a.exceptAll(rows.random_split(e.repartition(7), [0.5, 0.5], 1).select("event_id", "split")).count() == 0


def test_layout_check(small):
    want = T.StructType([T.StructField("ID", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("w", T.DateType())])
    assert rows.layout_check(small, want) == ["missing w", "unexpected name", "type of v: double is not string"]
    assert rows.layout_check(small, want, "subset") == ["unexpected name", "type of v: double is not string"]
    assert rows.conform(small, want).columns == ["ID", "v", "w"]


# ------------------------------------------------------------------ joins


def test_join_type_spellings():
    assert [joins.join_type(x) for x in ("LEFT OUTER", "full_outer", "Semi", "left anti", "CROSS")] == ["left", "full", "left_semi", "left_anti", "cross"]
    with pytest.raises(ValueError):
        joins.join_type("sideways")


def test_joins_with_null_keys_and_conflicts(spark, rows_of):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "A"), (None, "N"), (4, "D")], "k int, y string")
    assert rows_of(joins.join(a, b, ["k"], "full")) == sorted([(1, "a", "A"), (None, "n", None), (3, "c", None), (None, None, "N"), (4, None, "D")], key=repr)
    assert joins.join(a, b.withColumnRenamed("y", "x"), ["k"], conflict="drop_right").columns == ["k", "x"]
    with pytest.raises(ValueError):
        joins.join(a, b.withColumnRenamed("y", "x"), ["k"])
    with pytest.raises(ValueError):
        joins.join(a, b, [])


def test_semi_join_keeps_left_column_named_like_right_key(spark):
    a = spark.createDataFrame([(1, 9)], "k int, rk int")
    b = spark.createDataFrame([(1,)], "rk int")
    assert joins.join(a, b, [("k", "rk")], "semi").first() == (1, 9)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, rows_of, how):
    hot = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(7, "x"), (7, "y"), (250, "z")], "k bigint, r string")
    plain = rows_of(joins.join(hot, right, ["k"], how))
    assert rows_of(joins.join(hot, right, ["k"], how, salt=8, hot_rows=50)) == plain


def test_lookup_policies(spark):
    df = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    ref = spark.createDataFrame([(1, "one"), (2, None)], "k int, name string")
    got = {r["k"]: r["name"] for r in joins.lookup(df, ref, {"k": "k"}, ["name"], defaults={"name": "?"}).collect()}
    assert got == {1: "one", 2: None, 9: "?"}
    assert joins.lookup(df, ref, {"k": "k"}, ["name"], not_found="reject").count() == 2
    fails(lambda: joins.lookup(df, ref, {"k": "k"}, ["name"], not_found="fail").collect(), "no reference row for key 9")


def test_zip_fails_on_unequal_length(spark):
    fails(lambda: joins.zip_rows(spark.range(3), spark.range(2).toDF("b"), left_order="id", right_order="b", policy="fail").collect(), "differ in length")


def test_range_join_against_brute_force(spark, rows_of):
    p = spark.range(200).select((F.col("id") * 0.7 - 20).alias("p"))
    r = spark.createDataFrame([(0.0, 10.0), (-15.0, -14.0), (5.0, 90.0), (3.0, 3.0), (50.0, 49.0)], "lo double, hi double")
    want = rows_of(p.join(r, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))))
    for width in (1.0, 7.0, 500.0):
        assert rows_of(joins.range_join(p, r, point="p", low="lo", high="hi", width=width)) == want


def test_fuzzy_matches_against_brute_force(t, rows_of):
    words = t.documents.select(F.explode(F.split("text", r"\s+")).alias("w")).filter("length(w) BETWEEN 2 AND 6").distinct().orderBy("w").limit(150)
    ref = words.select(F.reverse("w").alias("m")).unionAll(words.select("w"))
    pairs = words.select(F.col("w").alias("value")).crossJoin(ref.select(F.col("m").alias("match")).distinct()).withColumn("distance", F.levenshtein("value", "match"))
    for d in (1, 2):
        assert rows_of(joins.levenshtein_match(words, ref, column="w", ref_column="m", max_distance=d)) == rows_of(pairs.filter(F.col("distance") <= d))
    ga, gb = joins.ngrams(F.col("value")), joins.ngrams(F.col("match"))
    shared = F.size(F.array_intersect(ga, gb))
    sim = pairs.select("value", "match", (shared / (F.size(ga) + F.size(gb) - shared)).alias("similarity"))
    for threshold in (0.3, 0.6):
        assert rows_of(joins.ngram_match(words, ref, column="w", ref_column="m", threshold=threshold)) == rows_of(sim.filter(F.col("similarity") >= threshold))


# ------------------------------------------------------------------ aggregates and sets


def test_distinct_sum_and_unknown_function(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    got = aggregates.aggregate(df, [], [Agg("sum", "x", "d", distinct=True), Agg("sum", "x", "s"), Agg("median", "x", "m")]).first()
    assert got == (3, 4, 1.0)


def test_aggregates_of_empty_input(small):
    none = small.limit(0)
    assert aggregates.aggregate(none, [], [Agg("count", "*", "n"), Agg("sum", "v", "s")]).first() == (0, None)
    assert aggregates.aggregate(none, ["name"], [Agg("count", "*", "n")]).count() == 0
    assert aggregates.exact_percentiles(none, ["name"], "v", {"m": 0.5}).count() == 0


def test_unpivot_of_pivot_is_the_input(spark, rows_of):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, c string, v int")
    wide = aggregates.pivot(df, ["k"], "c", [Agg("sum", "v", "v")])
    back = aggregates.unpivot(wide, ["k"], ["x", "y"], "c", "v", drop_nulls=True)
    assert rows_of(back) == rows_of(df.withColumn("v", F.col("v").cast("bigint")))
    with pytest.raises(ValueError):
        aggregates.pivot(df, ["k"], "c", [Agg("sum", "v", "v")], max_columns=1)


def test_set_operations_need_two_inputs(small):
    with pytest.raises(ValueError):
        sets.union_all(small)


def test_symmetric_difference_with_nulls_and_duplicates(spark, rows_of):
    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert rows_of(sets.symmetric_difference(a, b)) == sorted([(1,), (None,), (3,)], key=repr)


# ------------------------------------------------------------------ quality


def test_range_with_only_a_lower_bound_keeps_valid_and_null_rows(spark):
    df = spark.createDataFrame([(5.0,), (None,), (-2.5,), (0.0,)], "v double")
    good, bad = quality.quarantine(df, [Rule("min", "range", "v", low=0)])
    assert sorted(r["v"] for r in good.collect() if r["v"] is not None) == [0.0, 5.0] and good.count() == 3
    assert [r["v"] for r in bad.collect()] == [-2.5]


def test_good_and_bad_add_up_for_every_rule(small, spark, rows_of):
    ref = spark.createDataFrame([("a",)], "name string")
    rules = [Rule("a", "not_null", "name"), Rule("b", "range", "v", low=0, allow_null=False), Rule("c", "regex", "name", pattern="^[ab]$"), Rule("d", "custom", condition="v < 3"),
             Rule("e", "unique", "id"), Rule("f", "referential", "name", reference=ref), Rule("g", "enum", "name", values=["a"]), Rule("h", "length_range", "name", low=1, high=1), Rule("i", "not_empty", "name")]
    good, bad = quality.quarantine(small, rules)
    assert good.count() + bad.count() == small.count()
    failed = {(r["id"], tuple(r[quality.FAILED])) for r in bad.collect()}
    assert (2, ("a", "b", "d", "i")) in failed and (3, ("b", "f", "g")) in failed and (4, ("e",)) in failed and (1, ("d",)) in failed


def test_fail_action_stops_the_job(small):
    fails(lambda: quality.require(small, [Rule("positive", "range", "v", low=0)]).collect(), "data quality: positive")


def test_actions(small, spark):
    from millrace.session import scratch_path
    rules, path = [Rule("named", "not_null", "name")], scratch_path(spark, "bad")
    assert quality.enforce(small, rules, "warn").count() == 5 and quality.enforce(small, rules, "SKIP").count() == 4
    assert quality.enforce(small, rules, "QUARANTINE", path).count() == 4 and spark.read.parquet(path).count() == 1
    fails(lambda: quality.enforce(small, rules, "FAIL").collect(), "named")
    for bad in (lambda: quality.enforce(small, rules, "quarantine"), lambda: quality.enforce(small, rules, "explode")):
        with pytest.raises(ValueError):
            bad()


def test_masks_keep_nulls_and_types(small):
    masked = masking.mask(small, {"name": "replace", "v": "null"})
    assert dict(masked.dtypes)["v"] == "double" and masked.filter("name IS NULL").count() == 1
    text = small.select(F.lit("abc\ndef").alias("s"))
    assert {r["s"] for r in masking.mask(small.select(F.lit("abcdef").alias("s")), {"s": "regex_replace"}).collect()} == {"***"}
    assert text.count() == 5


# ------------------------------------------------------------------ merges


def test_duplicate_source_keys_are_an_error(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    fails(lambda: merge.upsert(target, twice, ["k"]).collect(), "several source rows for key 1")


def test_upsert_with_null_values_and_extra_target_columns(spark, rows_of):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, extra int")
    source = spark.createDataFrame([(1, None), (3, "c")], "k int, v string")
    assert rows_of(merge.upsert(target, source, ["k"])) == sorted([(10, 1, None), (20, 2, "b"), (None, 3, "c")], key=repr)
    assert rows_of(merge.upsert(target, source.limit(0), ["k"])) == rows_of(target)


def dimension(spark, data):
    return spark.createDataFrame(data, "k int, v string, effective_date date, end_date date, is_current boolean")


D1, D2, HIGH = dt.date(2020, 1, 1), dt.date(2021, 1, 1), dt.date(9999, 12, 31)


def test_scd2_null_changes_and_rerun(spark, rows_of):
    target = dimension(spark, [(1, "a", D1, HIGH, True), (2, None, D1, HIGH, True), (3, "c", D1, HIGH, True), (1, "z", dt.date(2019, 1, 1), D1, False)])
    source = spark.createDataFrame([(1, None), (2, None), (4, "n")], "k int, v string")
    args = dict(keys=["k"], tracked=["v"], as_of="2021-01-01")
    once = merge.scd2(target, source, **args)
    got = {(r["k"], r["v"], r["effective_date"], r["end_date"], r["is_current"]) for r in once.collect()}
    assert got == {(1, "z", dt.date(2019, 1, 1), D1, False), (1, "a", D1, D2, False), (1, None, D2, HIGH, True), (2, None, D1, HIGH, True), (3, "c", D1, HIGH, True), (4, "n", D2, HIGH, True)}
    assert rows_of(merge.scd2(once, source, **args)) == rows_of(once)


def test_scd2_surrogate_keys_differ_per_version(spark):
    target = dimension(spark, [(1, "a", D1, HIGH, True)]).withColumn("sk", F.lit(1).cast("bigint"))
    out = merge.scd2(target, spark.createDataFrame([(1, "b"), (2, "n")], "k int, v string"), keys=["k"], tracked=["v"], as_of="2021-01-01", surrogate="sk")
    assert out.select("sk").distinct().count() == 3 and out.filter("sk IS NULL").count() == 0


def test_change_hash_tells_null_positions(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    assert df.select(merge.change_hash(["x", "y", "z"]).alias("h")).distinct().count() == 3


def test_apply_changes_last_change_wins(spark, rows_of):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", "U", 1), (1, None, "D", 2), (3, None, "D", 1), (3, "n", "I", 2)], "k int, v string, op string, seq int")
    assert rows_of(merge.apply_changes(target, changes, ["k"], op="op", order_by=["seq"])) == sorted([(2, "b"), (3, "n")], key=repr)


# ------------------------------------------------------------------ nested, layout, functions


def test_explode_empty_and_null(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, a array<int>")
    assert nested.explode(df, "a").count() == 2 and nested.explode(df, "a", outer=True).count() == 4
    assert nested.explode(df, "a", outer=True, position="i", alias="x").columns == ["k", "a", "i", "x"]


def test_flatten_depth(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('a', named_struct('b', 2), 'c', 3) AS s")
    assert nested.flatten(df).columns == ["k", "s_a", "s_c"]
    assert nested.flatten(df, max_depth=5).columns == ["k", "s_a_b", "s_c"]
    assert nested.flatten(df, [], max_depth=5).columns == ["k", "s"]


def test_layout_without_arguments_stays_parallel(t):
    assert layout.repartition(t.orders, "none").rdd.getNumPartitions() == t.orders.rdd.getNumPartitions()
    assert layout.repartition(t.orders, "hash", n=5).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("lay", [
    lambda df, **kw: layout.repartition(df, "round_robin", **kw), lambda df, **kw: layout.repartition(df, "range", columns=["k", "j"], **kw),
    lambda df, **kw: layout.repartition(df, "hash", columns=["j"], **kw), lambda df, **kw: layout.clustered(df, ["k", "j"], **kw), lambda df, **kw: layout.z_ordered(df, ["k", "j"], **kw)],
    ids=["round_robin", "range", "hash", "clustered", "z_ordered"])
def test_long_tables_take_more_partitions(spark, lay):
    df = spark.range(4000).select((F.col("id") % 90).alias("k"), F.col("id").alias("j"))
    rows = [r["rows"] for r in layout.partition_sizes(lay(df, n=3, max_rows=200)).collect()]
    assert sum(rows) == 4000 and max(rows) < 600
    assert lay(df, n=3).rdd.getNumPartitions() == 3 == lay(df, n=3, max_rows=None).rdd.getNumPartitions() and lay(df, n=1, max_rows=200).rdd.getNumPartitions() == 1


def test_layout_queries_follow_the_table(spark, tmp_path, monkeypatch):
    """The layouts that the queries ask for have tasks that stay as large when the table grows."""
    spark.range(3000).selectExpr("id AS l_partkey", "id % 7 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes, kept = layout._sizes, []
    monkeypatch.setattr(layout, "_sizes", lambda df, n, max_rows: kept.append(sizes(df, n, 100)) or kept[-1])
    for name in ("repartition_round_robin", "clustered_layout"):
        found = load()[name](spark, str(tmp_path))
        assert found.agg(F.sum("n")).first()[0] == 3000
    assert kept == [[30], [30]]


def test_sql_function_and_custom_sql(spark):
    udfs.sql_function(spark, "twice", "x INT", "INT", "x * 2")
    out = udfs.custom_sql(spark, "SELECT twice(a.id) AS d FROM {input1} a JOIN {other} b ON a.id = b.id", spark.range(3).select(F.col("id").cast("int").alias("id")), other=spark.range(2))
    assert sorted(r["d"] for r in out.collect()) == [0, 2]
    with pytest.raises(ValueError):
        udfs.sql_function(spark, "x(); DROP", "x INT", "INT", "1")


# ------------------------------------------------------------------ NULL keys, long ranges, first matches


def test_null_group_is_a_group(spark):
    from millrace.operators import quality, scaling
    df = spark.createDataFrame([(None, float(v)) for v in (1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 90)] + [("a", 1.0), ("a", 2.0), ("a", None)], "g string, v double")
    flagged = quality.zscore_flags(df, "v", group_by=["g"], threshold=3.0)
    assert [r["g"] for r in flagged.filter("is_anomaly").collect()] == [None]
    assert quality.iqr_flags(df, "v", group_by=["g"]).filter("is_outlier").count() == 1
    scaled = scaling.scale(df, "v", "minmax", "s", ["g"])
    assert scaled.filter("g IS NULL AND s = 1.0").count() == 1 and scaled.count() == df.count()
    assert scaling.impute(df, "v", "mean", group_by=["g"]).filter("v = 1.5").count() == 1


def test_statistics_are_joined_without_a_shuffle_of_the_rows(t):
    from millrace.operators import quality
    plan = quality.zscore_flags(t.lineitem, "l_quantity", group_by=["l_returnflag"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("order", [("o", "asc", "last"), ("o", "asc", "first"), ("o", "desc", "last"), [("o", "desc", "first"), ("p", "asc")]])
def test_dedup_with_a_count_keeps_the_same_row(spark, order):
    from millrace.operators import rows
    df = spark.createDataFrame([(1, None, 1), (1, 5, 2), (1, 7, 3), (1, 7, 2), (None, 4, 4), (None, 2, 5)], "k int, o int, p int")
    order = order if isinstance(order, list) else [order, "p"]
    for keep in ("first", "last"):
        plain = rows.dedup(df, ["k"], keep=keep, order_by=order)
        counted = rows.dedup(df, ["k"], keep=keep, order_by=order, count_alias="n")
        assert {(*r, 4 if r["k"] else 2) for r in plain.collect()} == {tuple(r) for r in counted.collect()}


@pytest.mark.parametrize("pattern, new, want", [("(?<=a)b", "X", "aXab"), (r"\\bab", "X", "Xab"), ("^a", "X", "Xbab"), ("b(?=a)", "<$0>", None), ("(a)(b)", "$2$1", "baab"), ("z", "X", "abab"), ("b$", "X", "abaX")])
def test_first_match_sees_the_whole_text(spark, pattern, new, want):
    from millrace.functions.recipe import Recipe, Step, run_recipes
    pattern = pattern.replace("\\\\", "\\")
    if want is None:
        new, want = "<>", "a<>ab"
    df = spark.createDataFrame([("abab",)], "x string")
    step = Step("regex_replace", {"pattern": pattern, "replacement": new, "replaceAll": False})
    assert run_recipes(df, [Recipe("y", "x", [step])]).first()["y"] == want


def test_range_join_of_short_and_endless_ranges(spark):
    from millrace.operators import joins
    points = spark.createDataFrame([(float(p),) for p in (-5, 0, 1, 2.5, 9, 10, 1e9, 3e9)] + [(None,), (1.0,)], "x double")
    ranges = spark.createDataFrame([("short", 0.0, 1.0), ("long", -10.0, 3e9), ("exact", 1.0, 2.0), ("wide", 2.0, 10.0), ("empty", 5.0, 5.0), ("open", None, 4.0)], "name string, lo double, hi double")
    low = [tuple(r) for r in ranges.collect()]
    want = sorted((p, n) for (p,) in points.collect() if p is not None for n, a, b in low if a is not None and a <= p < b)
    got = joins.range_join(points, ranges, point="x", low="lo", high="hi", width=1.0)
    assert sorted((r["x"], r["name"]) for r in got.collect()) == want
    left = joins.range_join(points, ranges, point="x", low="lo", high="hi", width=1.0, how="left")
    assert left.columns == got.columns and left.count() == len(want) + 2 and left.filter("name IS NULL").count() == 2


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from millrace.session import require_local
    require_local("local[8]"), require_local("local[*]"), require_local("local[2, 3]")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            require_local(master)


def test_first_incremental_run_and_typed_marks(spark, t):
    import datetime as dt

    from millrace.session import scratch_path
    from millrace.sources import incremental
    path = scratch_path(spark, "marks")
    start = dt.datetime(2000, 1, 1)
    assert incremental.load_watermark(spark, path, "events", kind="timestamp_ntz", initial=start) == start
    incremental.save_watermark(incremental.next_watermark(t.events, "event_id", "events"), path)
    mark = incremental.load_watermark(spark, path, "events", kind="bigint", initial=0)
    assert mark == t.events.agg(F.max("event_id")).first()[0]
    assert incremental.above_watermark(t.events, "event_id", mark, look_back=10).count() == 10
    assert incremental.load_watermark(spark, path, "other", kind="bigint", initial=-1) == -1


# ------------------------------------------------------------------ overlaps, business keys, single replacements, interleaved ranks


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_overlap_and_range_joins_against_brute_force(spark, how):
    rnd = random.Random(3)
    side = lambda n, tag: [(f"{tag}{i}", rnd.choice([None, 1, 2]), lo, lo + rnd.choice([0, 1, 5, 40, 10**7])) for i in range(n) for lo in [rnd.randrange(-300, 300)]]
    a, b = side(60, "a"), [*side(70, "b"), ("open", 1, None, 5)]
    hit = lambda x, y: x[1] == y[1] and x[1] is not None and None not in (*x[2:], *y[2:]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    want = [(x[0], y[0]) for x in a for y in b if hit(x, y)]
    want += [(x[0], None) for x in a if how in ("left", "full") and not any(hit(x, y) for y in b)]
    want += [(None, y[0]) for y in b if how in ("right", "full") and not any(hit(x, y) for x in a)]
    left, right = spark.createDataFrame(a, "x string, k int, p bigint, q bigint"), spark.createDataFrame(b, "y string, k int, r bigint, s bigint")
    got = joins.overlap_join(left, right, left_range=("p", "q"), right_range=("r", "s"), width=10, on=["k"], how=how)
    assert sorted(map(repr, ((g["x"], g["y"]) for g in got.collect()))) == sorted(map(repr, want))
    inside = lambda x, y: x[1] == y[1] and x[1] is not None and None not in y[2:] and y[2] <= x[2] < y[3]
    want = [(x[0], y[0]) for x in a for y in b if inside(x, y)]
    want += [(x[0], None) for x in a if how in ("left", "full") and not any(inside(x, y) for y in b)]
    want += [(None, y[0]) for y in b if how in ("right", "full") and not any(inside(x, y) for x in a)]
    got = joins.range_join(left.drop("q"), right, point="p", low="r", high="s", width=10, on=["k"], how=how)
    assert sorted(map(repr, ((g["x"], g["y"]) for g in got.collect()))) == sorted(map(repr, want))


def test_null_business_keys_are_refused_and_flagged_once(spark):
    old, new = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int"), spark.createDataFrame([(None, 2), (1, 1)], "k int, v int")
    for run in (lambda: merge.upsert(old, new, ["k"]), lambda: merge.upsert(old, new, ["k"], latest_by=["v"])):
        with pytest.raises(Exception, match="NULL in a business key"):
            run().collect()
    assert sorted(map(tuple, merge.upsert(old, new.filter("k = 1"), ["k"]).collect()), key=repr) == [(1, 1), (None, 1)]
    assert sorted((r["change_type"] for r in merge.cdc_flags(old, new, ["k"]).collect())) == ["UNCHANGED", "UPDATE"]


@pytest.mark.parametrize("text,pattern,want", [("abc", "x*", "Rabc"), ("xxb", "x*", "Rb"), ("", "x*", "R"), ("abc", "$", "abcR"), ("a1b2", r"\d", "aRb2"), ("xx", "x+?", "Rx"), ("ab", "(?<=a)b", "aR"), ("Xx", "(?i)x", "Rx")])
def test_only_the_first_match_is_replaced(spark, text, pattern, want):
    from millrace.functions.recipe import Recipe, Step, run_recipes
    step = Step("replace_regex", {"pattern": pattern, "replacement": "R", "replaceAll": False})
    assert run_recipes(spark.createDataFrame([(text,)], "t string"), [Recipe("y", "t", [step])]).first()["y"] == want


def test_interleaved_ranks(spark):
    df = spark.range(4096).selectExpr("id % 64 AS a", "CAST(id DIV 64 AS double) AS b", "IF(id = 0, NULL, id) AS c")
    z = df.withColumn("z", layout.z_value(df, ["a", "b"], 6))
    assert z.select("z").distinct().count() == 4096
    low = z.filter("a < 32 AND b < 32").agg(F.max("z")).first()[0]
    assert low < z.filter("a >= 32 AND b >= 32").agg(F.min("z")).first()[0]
    assert df.withColumn("z", layout.z_value(df, ["c"], 4)).filter("c IS NULL").first()["z"] == 0
    assert layout.z_ordered(df, ["a", "b"], 8).count() == 4096 and layout.z_ordered(df.limit(0), ["a"], 4).count() == 0
    with pytest.raises(ValueError):
        layout.z_value(df, ["a", "b"], 40)


# ------------------------------------------------------------------ hot keys


@pytest.mark.parametrize("limit", [1, 20, 400, 5000])
def test_hot_groups_by_sketch_equal_a_full_count(spark, limit):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 7 = 0 THEN 'a' WHEN id % 11 = 0 THEN concat('b', id % 40) ELSE concat('k', id) END AS k", "id % 2 AS j")
    want = {tuple(r)[:2] for r in df.groupBy("k", "j").count().filter(F.col("count") > limit).collect()}
    found = sizing.hot_groups(df, ["k", "j"], limit, sketch=True)
    assert {tuple(r) for r in found.frame.collect()} == want and found.count == len(want)
    assert found.rows == sum(r["count"] for r in df.groupBy("k", "j").count().filter(F.col("count") > limit).collect())


def test_hot_candidates_read_keys_only_and_know_their_bound(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) AS k", "repeat('x', 50) AS rest").write.parquet(path)
    n, maybe = sizing.hot_candidates(spark.read.parquet(path), ["k"], 1000)
    assert n == 30_000 and maybe == [r[0] for r in spark.sql("SELECT xxhash64(-1L)").collect()]
    assert sizing.hot_candidates(spark.read.parquet(path), ["k"], 100, items=64) == (30_000, None)        # too long for 128 counters
    n, maybe = sizing.hot_candidates(spark.read.parquet(path).limit(0), ["k"], 10)
    assert n == 0 and maybe == []
    assert not sizing.hot_groups(spark.read.parquet(path).filter("k >= 0"), ["k"], 10, sketch=True).any


def test_salted_branch_is_in_the_plan_of_hot_keys_only(spark, capsys):
    left = spark.range(4000).selectExpr("if(id % 2 = 0, 0, id) AS k", "id AS v")
    right = spark.range(4000).selectExpr("id AS k", "id AS w")
    shown = lambda rows: (joins.join(left, right, ["k"], salt=8, hot_rows=rows).explain(), capsys.readouterr().out)[1]
    assert "pmod" in shown(1000) and "pmod" not in shown(3000)


# ------------------------------------------------------------------ routes and profiles


def test_route_writes_each_row_to_its_outputs(spark, rows_of):
    df = spark.createDataFrame([(1, 5, "a"), (2, 50, "a"), (3, 50, "z"), (4, 5, "z"), (5, None, None)], "k int, v int, s string")
    rules = [Rule("small", "range", "v", high=10, port="big"), Rule("known", "enum", "s", values=["a"], port="odd"), Rule("odd_key", "custom", condition="k % 2 = 0", policy="FLAG"), Rule("low", "range", "v", high=4, policy="LOG")]
    done = quality.route(df, rules)
    assert {p: [r["k"] for r in o.orderBy("k").collect()] for p, o in done.outputs.items()} == {"valid": [1, 5], "big": [2, 3], "odd": [3, 4]}
    assert done.rows == 5 and done.valid == 2 and done.failed == {"small": 2, "known": 2, "odd_key": 3, "low": 4}
    assert [r["_flag_odd_key"] for r in done.outputs["valid"].orderBy("k").collect()] == [True, True]
    assert done.outputs["odd"].orderBy("k").first()["_failed_rules"] == ["small", "known", "odd_key", "low"]
    empty = quality.route(df.limit(0), rules)
    assert empty.rows == 0 and all(o.count() == 0 for o in empty.outputs.values())
    fails(lambda: quality.route(df, [*rules, Rule("must", "not_null", "v", policy="FAIL")]), "{'must': 1}")
    fails(lambda: quality.route(df, [Rule("x", "not_null", "v", policy="IGNORE")]), "IGNORE")
    only_flags = quality.route(df, [Rule("x", "not_null", "v", policy="FLAG")])
    assert only_flags.valid == 5 and list(only_flags.outputs) == ["valid"]


def test_date_range_holds_the_whole_last_day(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-31 23:59:59' AS ts UNION ALL SELECT timestamp_ntz'2024-02-01 00:00:00'")
    kept = lambda high: quality.keep_valid(df, [Rule("r", "date_range", "ts", high=high)]).count()
    assert kept("2024-01-31") == kept(dt.date(2024, 1, 31)) == 1 and kept("2024-01-31 12:00:00") == 0 and kept(dt.datetime(2024, 2, 1)) == 2


@pytest.mark.parametrize("exact", [True, False])
def test_number_profile_edges(spark, exact):
    df = spark.createDataFrame([(1.0, 7, None), (2.0, 7, None), (2.0, 7, None), (float("nan"), 7, None), (None, 7, None), (11.0, 7, None)], "`a'b` double, `c``d` int, e double")
    got = {r["column_name"]: r for r in profile.number_profile(df, exact=exact).collect()}
    a, c, e = got["a'b"], got["c`d"], got["e"]
    assert (a["values_seen"], a["mode"], a["median"], a["histogram"]) == (4, 2.0, 2.0, [1, 2, 0, 0, 0, 0, 0, 0, 0, 1])
    assert (c["values_seen"], c["mode"], c["p99"], c["variance"], c["histogram"]) == (6, 7.0, 7.0, 0.0, [6] + [0] * 9)
    assert (e["values_seen"], e["mode"], e["median"], e["histogram"]) == (0, None, None, [])
    assert profile.number_profile(df.limit(0), exact=exact).filter("values_seen = 0").count() == 3
    assert profile.profile(df).count() == 3 and profile.frequencies(df, ["a'b", "c`d"]).count() == 6


# ------------------------------------------------------------------ closest texts


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.55, 0.75, 0.9, 1.0])
def test_best_match_equals_all_pairs(spark, threshold):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
    values, refs = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    want = {}
    for v in values:
        best = min((-(1 - _edits(v, r) / max(len(v), len(r), 1)), r) for r in refs)
        if -best[0] >= threshold - 1e-9:
            want[v] = (best[1], round(-best[0], 9))
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, None, *xs[:3]]], f"{c} string")
    got = joins.best_match(frame(values, "a"), frame(refs, "b"), column="a", ref_column="b", threshold=threshold).collect()
    assert {r["value"]: (r["match"], round(r["score"], 9)) for r in got} == want and len(got) == len(want)
    fails(lambda: joins.best_match(frame(values, "a"), frame(refs, "b"), column="a", ref_column="b", threshold=0.5), "above 0.5")


def test_join_condition_keeps_outer_rows_and_salts(spark, rows_of):
    left, right = spark.createDataFrame([(1, 5), (1, 50), (2, 5)], "k int, v int"), spark.createDataFrame([(1, 10), (3, 1)], "k int, v int")
    got = lambda **kw: rows_of(joins.join(left, right, ["k"], conflict="rename", renames={"v": "w"}, condition="v < w", **kw).select("k", "v", "w"))
    assert got(how="left") == sorted([(1, 5, 10), (1, 50, None), (2, 5, None)], key=repr)
    assert got(how="left", salt=4, hot_rows=1) == got(how="left")
    assert got(how="full") == sorted([(1, 5, 10), (1, 50, None), (2, 5, None), (3, None, 1)], key=repr)
    fails(lambda: joins.join(left, right, ["k"], conflict="rename", renames={}), "both sides")


def test_unique_keys_known_from_the_plan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, s string")
    path = str(tmp_path / "rows")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    grouped = df.groupBy("k").agg(F.max("s").alias("s"))
    assert sizing.unique_by_plan(grouped, ["k"]) and sizing.unique_by_plan(grouped.filter("s > 'a'"), ["s", "k"])
    assert not sizing.unique_by_plan(grouped, ["s"]) and not sizing.unique_by_plan(df, ["k"])
    assert not sizing.unique_by_plan(df.groupBy("k", "s").count(), ["k"])
    assert not sizing.unique_by_plan(grouped.withColumn("k", F.lit(1)), ["k"]) and not sizing.unique_by_plan(grouped.unionAll(grouped), ["k"])
    target = df.limit(0)
    fails(lambda: merge.upsert(target, df.filter("k = 1"), ["k"]).collect(), "several source rows")
    fails(lambda: merge.upsert(target, grouped, ["k"]).collect(), "NULL in a business key")
    assert merge.upsert(target, grouped.filter("k IS NOT NULL"), ["k"]).collect() == [(1, "b")]


def test_row_function_sees_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")
    out = udfs.apply_udf(df, lambda a, b: f"{a}/{b or '-'}", "string", [(["x", "y"], "z"), (["y", "x"], "w")], vectorised=False)
    assert sorted((r["z"], r["w"]) for r in out.collect()) == [("a/-", "None/a"), ("b/c", "c/b")]


def test_upsert_keeps_target_rows_with_null_keys_and_odd_columns(spark):
    target = spark.createDataFrame([(1, "a", None), (None, "b", "x"), (3, None, "y")], "k int, v string, kept string")
    source = spark.createDataFrame([(1, None, 9), (4, "d", 9), (3, None, 9)], "k int, v string, more int")
    rows = lambda df: sorted(((r["k"] or 0, r["v"] or "", r["kept"] or "") for r in df.collect()))
    done = merge.upsert(target, source, ["k"])
    assert done.columns == ["k", "v", "kept"] and rows(done) == [(0, "b", "x"), (1, "", ""), (3, "", "y"), (4, "d", "")]
    stamped = merge.upsert(target, source, ["k"], skip_unchanged=True, stamp=("kept", F.lit("now")))
    assert rows(stamped) == [(0, "b", "x"), (1, "", "now"), (3, "", "y"), (4, "d", "now")]
    assert rows(merge.upsert(target, source, ["k"], delete_unmatched=True)) == [(1, "", ""), (3, "", "y"), (4, "d", "")]


def test_null_keys_that_the_source_drops_are_no_error(spark):
    target = spark.createDataFrame([(1, 1)], "k int, n long")
    rows = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, 0)], "k int, open int")
    grouped = rows.groupBy("k").agg(F.sum("open").alias("n"))
    assert [tuple(r) for r in merge.upsert(target, grouped.filter("n > 0"), ["k"]).collect()] == [(1, 2)]
    for source, options in ((grouped, {}), (rows.select("k", F.col("open").cast("long").alias("n")), {"latest_by": ["n"]})):
        with pytest.raises(Exception, match="NULL in a business key"):
            merge.upsert(target, source, ["k"], **options).collect()
