"""Column recipes over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.recipe import RETURN_NULL, USE_DEFAULT, Recipe, Step, mapping_tree, run_recipes
from millrace.plans.registry import day, query, sql_day


@query("R0", "R1", sql="""
SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2))::DOUBLE AS brand_no,
  coalesce(TRY_CAST(regexp_replace(p_name, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2))::DOUBLE, -1.0) AS none FROM part""")
def recipe_to_number(t):
    out = run_recipes(t.part.select("p_partkey", "p_brand", "p_name"), [
        Recipe("brand_no", "p_brand", [Step("to_number", on_error=RETURN_NULL)]),
        Recipe("none", "p_name", [Step("to_number", on_error=USE_DEFAULT, default=-1)])])
    return out.select("p_partkey", F.col("brand_no").cast("double").alias("brand_no"), F.col("none").cast("double").alias("none"))


@query("R0", "R2", "R13", "R14", sql="""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS text, strftime(o_orderdate, '%Y-%m-%d') AS parsed, CAST(NULL AS VARCHAR) AS broken, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders""")
def recipe_dates_and_formats(t):
    df = run_recipes(t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), [
        Recipe("text", "o_orderdate", [Step("date_format", {"format": "dd/MM/yyyy"})]),
        Recipe("parsed", "text", [Step("to_date", {"format": "dd/MM/yyyy"})]),
        Recipe("broken", "o_orderpriority", [Step("to_date", {"format": "dd/MM/yyyy"}, RETURN_NULL)]),
        Recipe("stamp", "text", [Step("to_timestamp", {"format": "dd/MM/yyyy"}), Step("date_format", {"format": "yyyy-MM-dd HH:mm:ss"})]),
    ])
    return df.select("o_orderkey", "text", day("parsed").alias("parsed"), day("broken").alias("broken"), "stamp")


@query("R3", sql="""
SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS whole, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, TRY_CAST(o_orderpriority AS INTEGER) AS bad, coalesce(TRY_CAST(o_orderstatus AS INTEGER), 7) AS dflt,
  o_orderkey != 0 AS flag FROM orders""")
def recipe_casts(t):
    cast = lambda kind, **k: Step("cast", {"targetType": kind}, **k)
    return run_recipes(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), [
        Recipe("whole", "o_totalprice", [cast("INTEGER")]), Recipe("amount", "o_totalprice", [cast("DECIMAL"), cast("TEXT")]),
        Recipe("bad", "o_orderpriority", [cast("INTEGER", on_error=RETURN_NULL)]), Recipe("dflt", "o_orderstatus", [cast("INTEGER", on_error=USE_DEFAULT, default=7)]),
        Recipe("flag", "o_orderkey", [cast("BOOLEAN")]),
    ]).select("o_orderkey", "whole", "amount", "bad", "dflt", "flag")


@query("R4", "R5", "R6", "R7", "R8", "R9", "R10", sql="""
SELECT c_custkey, rtrim(ltrim('  ' || c_name || ' ')) AS trimmed, ltrim('  ' || c_name || ' ') AS left_trimmed, rtrim('  ' || c_name || ' ') AS right_trimmed, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, CAST(length(c_name) AS INTEGER) AS len, c_name || '-' || c_mktsegment AS joined, substring(c_name, 3, 4) AS part,
  lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, rpad(c_name, 5, '.') AS cut, replace(c_name, '#', '/') AS swapped FROM customer""")
def recipe_text_steps(t):
    df = t.customer.withColumn("padded_name", F.concat(F.lit("  "), "c_name", F.lit(" ")))
    s = lambda kind, **p: [Step(kind, p)]
    return run_recipes(df, [
        Recipe("trimmed", "padded_name", s("trim")), Recipe("left_trimmed", "padded_name", s("trim", sides="LEFT")), Recipe("right_trimmed", "padded_name", s("rtrim")),
        Recipe("up", "c_mktsegment", s("upper")), Recipe("low", "c_mktsegment", s("lower")), Recipe("title", "c_mktsegment", s("title_case")), Recipe("len", "c_name", s("length")),
        Recipe("joined", "c_name", s("concat", values=["'-'", "c_mktsegment"])), Recipe("part", "c_name", s("substring", startPos=3, length=4)),
        Recipe("padded", "c_custkey", s("pad_left", length=6)), Recipe("cut", "c_name", s("pad_right", length=5, padChar=".")), Recipe("swapped", "c_name", s("replace", search="#", replace="/")),
    ]).drop("padded_name", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("R11", "R12", "R15", "R31", sql=f"""
SELECT o_orderkey, {sql_day('o_orderdate')} AS d, {sql_day("date_trunc('month', o_orderdate)")} AS m, {sql_day("date_trunc('year', o_orderdate)")} AS y, {sql_day("o_orderdate + INTERVAL 10 DAY")} AS plus_days,
  {sql_day("o_orderdate + INTERVAL 2 MONTH")} AS plus_months, {sql_day("o_orderdate - INTERVAL 1 YEAR")} AS minus_year, CAST(year(o_orderdate) AS INTEGER) AS yy, CAST(month(o_orderdate) AS INTEGER) AS mm, CAST(day(o_orderdate) AS INTEGER) AS dd FROM orders""")
def recipe_date_steps(t):
    s = lambda kind, **p: [Step(kind, p)]
    out = run_recipes(t.orders.select("o_orderkey", "o_orderdate"), [
        Recipe("d", "o_orderdate", s("trim_timestamp", unit="DAY")), Recipe("m", "o_orderdate", s("trim_timestamp", unit="MONTH")), Recipe("y", "o_orderdate", s("trim_timestamp", unit="YEAR")),
        Recipe("plus_days", "o_orderdate", s("date_add", amount=10)), Recipe("plus_months", "o_orderdate", s("date_add", amount=2, unit="MONTH")), Recipe("minus_year", "o_orderdate", s("date_sub", amount=1, unit="YEAR")),
        Recipe("yy", "o_orderdate", s("extract_date_part", part="YEAR")), Recipe("mm", "o_orderdate", s("extract_date_part")), Recipe("dd", "o_orderdate", s("extract_date_part", part="DAY"))])
    return out.select("o_orderkey", *[day(c).alias(c) for c in ("d", "m", "y", "plus_days", "plus_months", "minus_year")], "yy", "mm", "dd")


@query("R15", sql="SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events")
def recipe_time_parts(t):
    return run_recipes(t.events.select("event_id", "ts"), [Recipe(a, "ts", [Step("extract_date_part", {"part": p})]) for a, p in (("h", "HOUR"), ("mi", "MINUTE"), ("s", "SECOND"))]).drop("ts")


# Whole months as Spark counts them: a later day of month in the start lowers the count, except
# between two month ends; negative spans round down.
MONTHS = """(year(e) - year(b)) * 12 + month(e) - month(b) - CASE WHEN day(e) < day(b) AND NOT (e = last_day(e) AND b = last_day(b)) THEN 1 ELSE 0 END"""


@query("R16", sql=f"""
SELECT o_orderkey, CAST(date_diff('day', b, e) AS INTEGER) AS days, CAST({MONTHS} AS BIGINT) AS months, CAST(floor(({MONTHS}) / 12.0) AS BIGINT) AS years
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, DATE '1998-06-15' AS e FROM orders)""")
def recipe_date_diff(t):
    end = F.lit("1998-06-15").cast("date")
    return run_recipes(t.orders.select("o_orderkey", "o_orderdate"), [Recipe(a, "o_orderdate", [Step("date_diff", {"endDate": end, "unit": u})]) for a, u in
                                                                     (("days", "DAY"), ("months", "MONTH"), ("years", "YEAR"))]).drop("o_orderdate")


@query("R17", "R18", "R19", "R29", sql=r"""
SELECT c_custkey, regexp_extract(c_name, '(\d+)', 1) AS digits, regexp_extract(c_name, '(?i)CUSTOMER#0*(\d+)', 1) AS number, regexp_extract(c_name, '(x+)', 1) AS no_match, regexp_replace(c_name, '0+', '_', 'g') AS all_replaced,
  regexp_replace(c_name, '0', '_') AS first_replaced, regexp_matches(c_mktsegment, '^(BUILD|FURN)') AS starts, regexp_matches(c_mktsegment, '(?i)ing$') AS ends FROM customer""")
def recipe_regex_steps(t):
    s = lambda kind, **p: [Step(kind, p)]
    return run_recipes(t.customer.select("c_custkey", "c_name", "c_mktsegment"), [
        Recipe("digits", "c_name", s("regex_extract", template="digits")), Recipe("number", "c_name", s("extract_regex", pattern=r"CUSTOMER#0*(\d+)", caseInsensitive=True)),
        Recipe("no_match", "c_name", s("regex_extract", pattern="(x+)")), Recipe("all_replaced", "c_name", s("replace_regex", pattern="0+", replacement="_")),
        Recipe("first_replaced", "c_name", s("replace_regex", pattern="0", replacement="_", replaceAll=False)),
        Recipe("starts", "c_mktsegment", s("matches_regex", pattern="^(BUILD|FURN)")), Recipe("ends", "c_mktsegment", s("matches_regex", pattern="ing$", caseInsensitive=True)),
    ]).drop("c_name", "c_mktsegment")


@query("R17", "R29", sql=r"""
SELECT doc_id, regexp_extract(text, '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})', 1) AS email, regexp_extract(text, '(\d{3}[-.]\d{3}[-.]\d{4})', 1) AS us_phone, regexp_extract(text, '(https?://[^\s]+)', 1) AS url,
  regexp_extract(text, '(\d{2}/\d{2}/\d{4})', 1) AS date, regexp_extract(text, '\(([^)]+)\)', 1) AS in_parentheses, regexp_extract(text, '([A-Z]+)', 1) AS capitals FROM documents""")
def recipe_named_patterns(t):
    """Pattern templates over whole document texts."""
    names = ("email", "us_phone", "url", "date", "in_parentheses", "capitals")
    return run_recipes(t.documents.select("doc_id", "text"), [Recipe(n, "text", [Step("regex_extract", {"template": n})]) for n in names]).drop("text")


@query("R20", "R21", "R22", "R28", "R31", sql="""
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus, 'none') AS filled, nullif(o_orderstatus, 'P') AS nulled, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN o_orderstatus ELSE 'small' END AS size,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, CASE WHEN o_orderpriority LIKE '1%' THEN 'u' WHEN o_orderpriority LIKE '%LOW' THEN 'l' WHEN o_orderpriority LIKE '%PEC%' THEN 's' ELSE 'o' END AS code,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label FROM orders""")
def recipe_branches(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return run_recipes(df, [
        Recipe("filled", "o_orderpriority", [Step("null_if", {"value": "'5-LOW'"}), Step("coalesce", {"fallbacks": ["o_orderstatus", "'none'"]})]),
        Recipe("nulled", "o_orderstatus", [Step("nullif", {"value": "'P'"})]),
        Recipe("size", "o_totalprice", [Step("case_when", {"branches": [{"when": "o_totalprice > 200000", "then": "'big'"}, {"when": "o_totalprice > 50000", "then": "o_orderstatus"}], "else": "'small'"})]),
        Recipe("done", "o_orderstatus", [Step("if_else", {"condition": "o_orderstatus = 'F'", "then": 1, "else": 0})]),
        Recipe("code", "o_orderpriority", [Step("case_conditions", {"conditions": [("o_orderpriority", "starts_with", "1", "'u'"), ("o_orderpriority", "ends_with", "LOW", "'l'"), ("o_orderpriority", "contains", "PEC", "'s'")], "else": "'o'"})]),
        Recipe("label", "o_orderstatus", [Step("map_lookup", {"map": {"F": "finished", "O": "open"}, "default": "other"})]),
    ]).drop("o_orderstatus", "o_orderpriority", "o_totalprice")


@query("R23", "R24", "R25", "R30", sql="""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN ceil(c_acctbal * 10.0) / 10.0 ELSE -ceil(-c_acctbal * 10.0) / 10.0 END AS up, sign(c_acctbal) * floor(abs(c_acctbal) * 10.0) / 10.0 AS down, abs(c_acctbal) AS a,
  CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, c_custkey % 7 AS m, round(pow(c_acctbal, 2), 4) AS p, round(sqrt(abs(c_acctbal)), 6) AS root, sign(c_acctbal)::DOUBLE AS s, sign(c_acctbal) * floor(abs(c_acctbal)) AS t FROM customer""")
def recipe_number_steps(t):
    s = lambda kind, **p: [Step(kind, p)]
    out = run_recipes(t.customer.select("c_custkey", "c_acctbal"), [
        Recipe("up", "c_acctbal", s("round", places=1, mode="UP")), Recipe("down", "c_acctbal", s("round", places=1, mode="DOWN")), Recipe("a", "c_acctbal", s("abs")), Recipe("c", "c_acctbal", s("ceil")),
        Recipe("f", "c_acctbal", s("floor")), Recipe("m", "c_custkey", s("mod", divisor=7)), Recipe("p", "c_acctbal", s("power")), Recipe("root", "c_acctbal", [Step("abs"), Step("sqrt")]), Recipe("s", "c_acctbal", s("sign")),
        Recipe("t", "c_acctbal", s("trunc")),
    ]).drop("c_acctbal")
    return out.withColumns({"p": F.round("p", 4), "root": F.round("root", 6)})


@query("R23", sql="SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(15,2)), 1) AS DOUBLE) AS half_up FROM customer")
def recipe_round_half_up(t):
    df = t.customer.select("c_custkey", F.col("c_acctbal").cast("decimal(15,2)").alias("b"))
    return run_recipes(df, [Recipe("half_up", "b", [Step("round", {"places": 1})])]).select("c_custkey", F.col("half_up").cast("double").alias("half_up"))


@query("R26", sql="SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * 2 AS net FROM lineitem")
def recipe_custom_sql(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return run_recipes(df, [Recipe("net", "l_extendedprice", [Step("custom_sql", {"expression": "net * (1 - l_discount)"}), Step("math", {"operator": "*", "operand": 2})])]).drop("l_extendedprice", "l_discount")


@query("R27", sql="""
SELECT o_orderkey, (o_totalprice + 100) / 4 AS scaled, CASE WHEN o_custkey = 0 THEN NULL ELSE o_totalprice / o_custkey END AS per_key, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS BIGINT) AS place,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-31') AS INTEGER) AS age_days, 'nightly' AS job FROM orders""")
def mapping_tree_operations(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy/MM/dd").alias("ordered"))
    op = lambda name, **p: {"operation": name, "params": p}
    df = mapping_tree(df, "scaled", "o_totalprice", {"children": [op("math", operator="+", operand=100), {"kind": "sequence", "children": [op("math", operator="/", operand=4)]}]})
    df = mapping_tree(df, "per_key", "o_totalprice", {"children": [{"operation": "math", "params": {"operator": "/", "operand": "o_custkey"}, "on_error": RETURN_NULL}]})
    df = mapping_tree(df, "place", "o_totalprice", {"children": [op("rank", partitionBy="o_orderstatus", orderBy="o_totalprice")]})
    df = mapping_tree(df, "age_days", "ordered", {"children": [op("date_diff", endDate="'31.01.2002'", sourceFormat="yyyy/MM/dd", endFormat="dd.MM.yyyy")]})
    df = mapping_tree(df, "job", "o_orderstatus", {"children": [op("current_job_name", jobName="nightly")]})
    return df.select("o_orderkey", "scaled", "per_key", F.col("place").cast("bigint").alias("place"), "age_days", "job")


@query("R28", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN upper(substr(o_orderpriority, 3)) WHEN o_orderpriority LIKE '1%' THEN lower(o_orderpriority) || '!' ELSE o_orderpriority END AS label,
  substr(o_orderpriority, 1, 1) || '-' || lower(substr(o_orderpriority, 3)) || '-' || lower(substr(o_orderpriority, 3)) AS joined,
  greatest(o_totalprice / 4, o_totalprice - 100000) + 1 AS most, CASE WHEN o_orderpriority LIKE '5%' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) ELSE 0 END AS five FROM orders""")
def mapping_tree_groups(t):
    """Groups of each kind, nested: the same child twice is computed once, a branch cannot fail on rows of others."""
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    op = lambda name, **p: {"operation": name, "params": p}
    name = {"children": [op("substring", startPos=3, length=100), op("lower")]}
    df = mapping_tree(df, "label", "o_orderpriority", {"kind": "case", "children": [
        {"when": ("o_orderstatus", "=", "F"), "children": [op("substring", startPos=3, length=100), op("upper")]},
        {"when": ("o_orderpriority", "starts_with", "1"), "children": [op("lower"), {"kind": "parallel", "combine": "concat", "children": [{"children": []}, op("custom_sql", expression="'!'")]}]}]})
    df = mapping_tree(df, "joined", "o_orderpriority", {"kind": "parallel", "combine": "concat", "separator": "-", "children": [op("substring", startPos=1, length=1), name, name]})
    df = mapping_tree(df, "most", "o_totalprice", {"children": [
        {"kind": "parallel", "combine": "greatest", "children": [op("math", operator="/", operand=4), op("math", operator="-", operand=100000)]}, op("math", operator="+", operand=1)]})
    df = mapping_tree(df, "five", "o_orderpriority", {"kind": "case", "children": [
        {"when": ("o_orderpriority", "starts_with", "5"), "children": [op("substring", startPos=1, length=1), op("cast", targetType="INTEGER")]}], "else": op("custom_sql", expression="0")})
    return df.drop("o_orderstatus", "o_orderpriority", "o_totalprice")


@query("R27", sql="""
SELECT o_orderkey, CASE WHEN day(e) = day(b) OR (e = last_day(e) AND b = last_day(b)) THEN (year(e) - year(b)) * 12 + month(e) - month(b)
  ELSE round((year(e) - year(b)) * 12 + month(e) - month(b) + (day(e) - day(b)) / 31.0, 8) END::DOUBLE AS months FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, DATE '2002-01-31' AS e FROM orders)""")
def mapping_tree_fractional_months(t):
    df = mapping_tree(t.orders.select("o_orderkey", "o_orderdate"), "months", "o_orderdate", {"children": [
        {"operation": "date_diff", "params": {"endDate": F.lit("2002-01-31").cast("date"), "unit": "MONTH", "fractional": True}}]})
    return df.drop("o_orderdate")
