"""One-row samples for every recipe step, error policies and scalar helpers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as s
from millrace.functions.recipe import FAIL, RETURN_NULL, USE_DEFAULT, Recipe, Step, mapping_tree, run_recipes, step_types

TS = dt.datetime(2024, 6, 15, 14, 32)
SAMPLES = [
    ("1,200.50", [Step("to_number")], Decimal("1200.50")), ("15-Jun-2024", [Step("to_date", {"format": "dd-MMM-yyyy"})], dt.date(2024, 6, 15)), (1200.75, [Step("cast", {"targetType": "INTEGER"})], 1200),
    ("ORDER-20240615", [Step("substring", {"startPos": 7, "length": 8})], "20240615"), ("  Hello World  ", [Step("trim")], "Hello World"), ("  Hello", [Step("ltrim")], "Hello"), ("Hello  ", [Step("rtrim")], "Hello"),
    ("hello world", [Step("upper")], "HELLO WORLD"), ("HELLO WORLD", [Step("lower")], "hello world"), ("hello world", [Step("title_case")], "Hello World"), ("Hello", [Step("length")], 5),
    ("Hello", [Step("concat", {"values": ["' World'"]})], "Hello World"), ("Hello", [Step("concat", {"values": [None]})], None), ("42", [Step("pad_left")], "0000000042"), ("Hi", [Step("pad_right")], "Hi        "), ("abcdef", [Step("pad_left", {"length": 3})], "abc"),
    ("Hello, World!", [Step("replace", {"search": "World", "replace": "Planet"})], "Hello, Planet!"), (TS, [Step("trim_timestamp")], dt.date(2024, 6, 15)), (TS, [Step("trim_timestamp", {"unit": "YEAR"})], dt.date(2024, 1, 1)),
    (dt.date(2024, 6, 15), [Step("date_add", {"amount": 30})], dt.date(2024, 7, 15)), (dt.date(2024, 1, 31), [Step("date_add", {"amount": 1, "unit": "MONTH"})], dt.date(2024, 2, 29)), (dt.date(2024, 6, 15), [Step("date_sub", {"amount": 15})], dt.date(2024, 5, 31)),
    ("2024-06-15 14:30:00", [Step("to_timestamp")], dt.datetime(2024, 6, 15, 14, 30)), (dt.date(2024, 6, 15), [Step("date_format", {"format": "dd/MM/yyyy"})], "15/06/2024"), (dt.date(2024, 6, 15), [Step("extract_date_part")], 6),
    (dt.date(2024, 1, 1), [Step("date_diff", {"endDate": "DATE'2024-06-29'"})], 180), (dt.date(2024, 3, 31), [Step("date_diff", {"endDate": "DATE'2024-02-28'", "unit": "MONTH"})], -2),
    (1200.567, [Step("round")], 1200.57), (-1.21, [Step("round", {"places": 1, "mode": "UP"})], -1.3), (-1.29, [Step("round", {"places": 1, "mode": "DOWN"})], -1.2), (1200.99, [Step("floor")], 1200), (1200.01, [Step("ceil")], 1201), (-42.5, [Step("abs")], 42.5),
    (17, [Step("mod", {"divisor": 4})], 1), (3, [Step("power")], 9.0), ("REF: ORD-2024-001", [Step("regex_extract", {"pattern": r"ORD-(\d{4}-\d{3})"})], "2024-001"), ("nothing", [Step("extract_regex", {"pattern": r"(\d+)"})], ""),
    ("Hello, World!", [Step("replace_regex", {"pattern": "[^A-Za-z]", "replacement": ""})], "HelloWorld"), ("a1b2", [Step("replace_regex", {"pattern": r"\d", "replacement": "#", "replaceAll": False})], "a#b2"), ("abc", [Step("replace_regex", {"pattern": r"\d", "replacement": "#", "replaceAll": False})], "abc"),
    ("ORD-1234", [Step("matches_regex", {"pattern": r"^ORD-\d+$"})], True), (None, [Step("if_null", {"fallbacks": ["'Unknown'"]})], "Unknown"), (None, [Step("coalesce", {"defaultValue": "'x'"})], "x"), ("N/A", [Step("null_if", {"value": "'N/A'"})], None),
    ("ACTIVE", [Step("case_when", {"branches": [{"when": "out = 'ACTIVE'", "then": "'Active Customer'"}], "else": "'Other'"})], "Active Customer"), ("a@b.co x", [Step("regex_extract", {"template": "email"})], "a@b.co"), ("start STARTmidEND", [Step("regex_extract", {"template": "between_markers"})], "mid"),
    (2.0, [Step("math", {"operator": "*", "operand": 3}), Step("math", {"operator": "-", "operand": 1})], 5.0), (10.0, [Step("math", {"operator": "/", "operand": 0}, RETURN_NULL)], None), (2.789, [Step("trunc", {"places": 1})], 2.7), (9.0, [Step("sqrt")], 3.0),
    ("7", [Step("cast", {"targetType": "SOMETHING"})], "7"), ("x", [Step("current_job_name", {"jobName": "job"})], "job"), ("x", [Step("upper", enabled=False)], "x"), ("x", [], "x"),
]


@pytest.mark.parametrize("given, steps, want", SAMPLES, ids=lambda v: str(v)[:30])
def test_samples(spark, given, steps, want):
    kinds = {str: "string", float: "double", int: "int", dt.date: "date", dt.datetime: "timestamp_ntz", type(None): "string"}
    df = spark.createDataFrame([(given,)], f"src {kinds[type(given)]}")
    got = run_recipes(df, [Recipe("out", "src", steps)]).first()["out"]
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_error_policies(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "src string")
    run = lambda **k: [r["out"] for r in run_recipes(df, [Recipe("out", "src", [Step("cast", {"targetType": "INTEGER"}, **k)])]).collect()]
    assert run(on_error=RETURN_NULL) == [12, None, None] and run(on_error=USE_DEFAULT, default=-1) == [12, -1, -1]
    with pytest.raises(Exception):
        run(on_error=FAIL)


def test_unknown_step_is_skipped_with_a_warning(spark):
    with pytest.warns(UserWarning, match="unknown step 'sparkle'"):
        out = run_recipes(spark.createDataFrame([("a",)], "src string"), [Recipe("out", "src", [Step("sparkle"), Step("upper")]), Recipe("off", "src", enabled=False)])
    assert out.columns == ["src", "out"] and out.first()["out"] == "A"


def test_recipes_read_earlier_outputs(spark):
    df = run_recipes(spark.range(3), [Recipe("a", "id", [Step("math", {"operator": "+", "operand": 1}), Step("abs")]), Recipe("b", "a", [Step("custom_sql", {"expression": "a * 10 + id"})])])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(0, 1, 10), (1, 2, 21), (2, 3, 32)]


def test_all_step_types_are_known():
    assert {"to_number", "map_lookup", "rank", "case_when", "custom_sql", "atan2", "random"} <= set(step_types())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_edges(spark):
    lit = F.lit
    assert one(spark, s.nth_position(lit("a.b.c.d"), ".", 3)) == 6 and one(spark, s.nth_position(lit("abc"), ".", 1)) == 0 and one(spark, s.nth_position(lit(None).cast("string"), ".", 1)) is None
    assert one(spark, s.trunc_number(lit(-2.79), 1)) == pytest.approx(-2.7) and one(spark, s.clamp(lit(7), 1, 5)) == 5
    assert one(spark, s.remove_diacritics(lit("Çà et là"))) == "Ca et la" and one(spark, s.to_snake_case(lit("myColumnName"))) == "my_column_name" and one(spark, s.to_camel_case(lit("my_column name"))) == "myColumnName"
    assert one(spark, s.choose(lit(5), "a", "b")) is None and one(spark, s.decode(lit(None).cast("string"), {None: "none"}, "x")) == "none"
    assert one(spark, s.integer_div(lit(-7), lit(2))) == -3 and one(spark, s.hex_to_int(lit("ff"))) == 255


@pytest.mark.parametrize("start", [dt.date(2024, 6, 10) + dt.timedelta(days=i) for i in range(7)])
@pytest.mark.parametrize("days", [0, 1, 4, 5, 11])
def test_business_days_against_a_calendar_walk(spark, start, days):
    day = start
    while day.weekday() > 4:
        day -= dt.timedelta(days=1)
    left = days
    while left:
        day += dt.timedelta(days=1)
        left -= day.weekday() < 5
    assert one(spark, s.add_business_days(F.lit(start), days)) == day
    end = start + dt.timedelta(days=days * 3)
    walked = sum((start + dt.timedelta(days=i)).weekday() < 5 for i in range((end - start).days))
    assert one(spark, s.business_days_between(F.lit(start), F.lit(end))) == walked


def test_mapping_tree_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "7")], "k int, v string")
    op = lambda name, **p: {"operation": name, "params": p}
    run = lambda tree: [r["v"] for r in mapping_tree(df, "v", "v", tree).orderBy("k").collect()]     # the source itself is replaced
    assert run({"children": []}) == ["a", None, "7"]
    assert run({"kind": "parallel", "children": []}) == ["a", None, "7"]
    assert run({"kind": "parallel", "children": [op("null_if", value="'a'"), op("coalesce", fallbacks=["'z'"])]}) == ["a", "z", "7"]
    assert run({"kind": "parallel", "combine": "array", "children": [op("upper"), op("lower")]}) == [["A", "a"], [None, None], ["7", "7"]]
    digits = {"kind": "case", "children": [{"when": ("k", "=", 3), "children": [op("cast", targetType="INTEGER")]}], "else": op("custom_sql", expression="-1")}
    assert run(digits) == [-1, -1, 7]                                                               # "a" never meets the strict cast
    assert mapping_tree(df, "v", "v", digits).columns == ["k", "v"]
    for wrong in ({"kind": "loop", "children": []}, {"kind": "parallel", "combine": "sum", "children": [op("upper")]}):
        with pytest.raises(ValueError):
            run(wrong)
