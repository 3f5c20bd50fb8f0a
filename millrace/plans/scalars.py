"""The scalar function groups, one query each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as s
from millrace.plans.registry import day, query, sql_day


@query("F1", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(ceil(l_discount * 10) AS BIGINT) AS up, CAST(floor(l_discount * 10) AS BIGINT) AS down, sign(l_extendedprice) * floor(abs(l_extendedprice) * 10.0) / 10.0 AS cut, abs(l_discount - 1) AS a, l_partkey % 7 AS m,
  l_partkey // 7 AS d, round(pow(l_quantity, 1.5), 6) AS p, round(sqrt(l_quantity), 9) AS r, round(cbrt(l_quantity), 9) AS c, round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS l10, round(ln(l_quantity) / ln(2), 9) AS l2, round(exp(l_discount), 9) AS e FROM lineitem""")
def numeric_basic(t):
    q, x = F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.ceil(x * 10).alias("up"), F.floor(x * 10).alias("down"), s.trunc_number("l_extendedprice", 1).alias("cut"), F.abs(x - 1).alias("a"),
                             (F.col("l_partkey") % 7).alias("m"), s.integer_div("l_partkey", F.lit(7)).alias("d"), F.round(F.pow(q, 1.5), 6).alias("p"), F.round(F.sqrt(q), 9).alias("r"), F.round(F.cbrt(q), 9).alias("c"),
                             F.round(F.ln(q), 9).alias("l"), F.round(F.log10(q), 9).alias("l10"), F.round(s.log_base(q, 2), 9).alias("l2"), F.round(F.exp(x), 9).alias("e"))


@query("F2", sql="""
SELECT c_custkey, sign(c_acctbal)::DOUBLE AS sg, least(c_acctbal, 1000.0, c_nationkey::DOUBLE) AS lo, greatest(c_acctbal, 1000.0) AS hi, least(greatest(c_acctbal, 0.0), 5000.0) AS clamped, true AS rand_in_range, true AS int_in_range FROM customer""")
def numeric_compare_and_random(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.signum(b).alias("sg"), F.least(b, F.lit(1000.0), F.col("c_nationkey").cast("double")).alias("lo"), F.greatest(b, F.lit(1000.0)).alias("hi"), s.clamp(b, 0.0, 5000.0).alias("clamped"),
                             ((F.rand(1) >= 0) & (F.rand(1) < 1)).alias("rand_in_range"), s.random_int(3, 9, 2).between(3, 9).alias("int_in_range"))


@query("F3", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(tan(l_discount), 9) AS t, round(asin(l_discount), 9) AS asn, round(acos(l_discount), 9) AS acs, round(atan(l_quantity), 9) AS atn,
  round(atan2(l_quantity, l_tax + 1), 9) AS at2, round(sinh(l_discount), 9) AS sh, round(cosh(l_discount), 9) AS ch, round(tanh(l_discount), 9) AS th, round(pi() * l_quantity, 9) AS pi_q, round(radians(l_quantity), 9) AS rad, round(degrees(l_discount), 9) AS deg FROM lineitem""")
def numeric_trigonometry(t):
    q, d = F.col("l_quantity"), F.col("l_discount")
    exprs = {"s": F.sin(q), "c": F.cos(q), "t": F.tan(d), "asn": F.asin(d), "acs": F.acos(d), "atn": F.atan(q), "at2": F.atan2(q, F.col("l_tax") + 1), "sh": F.sinh(d), "ch": F.cosh(d), "th": F.tanh(d), "pi_q": F.pi() * q, "rad": F.radians(q), "deg": F.degrees(d)}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", *[F.round(e, 9).alias(a) for a, e in exprs.items()])


@query("F4", sql="""
SELECT o_orderkey, format('{:,}', o_orderkey) AS grouped, bin(o_orderkey) AS b, hex(o_orderkey) AS h, o_orderkey AS back FROM orders""")
def numeric_formats(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.format_number(k, 0).alias("grouped"), F.bin(k).alias("b"), F.hex(k).alias("h"), s.hex_to_int(F.hex(k)).alias("back"))


@query("F5", sql="""
SELECT p_partkey, trim(p_brand, 'B2') AS both_ends, ltrim(p_brand, 'Br') AS l, rtrim(p_brand, '0123456789') AS r, upper(p_name) AS up, lower(p_type) AS low, lpad(p_brand, 10, '*') AS lp, rpad(p_brand, 10, '*') AS rp FROM part""")
def text_trim_case_pad(t):
    b = F.col("p_brand")
    return t.part.select("p_partkey", F.btrim(b, F.lit("B2")).alias("both_ends"), F.ltrim(b, F.lit("Br")).alias("l"), F.rtrim(b, F.lit("0123456789")).alias("r"), F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.lpad(b, 10, "*").alias("lp"), F.rpad(b, 10, "*").alias("rp"))


@query("F6", sql="""
SELECT doc_id, substring(text, 2, 5) AS sub, CAST(instr(text, 'the') AS INTEGER) AS at, CAST(octet_length(encode(text)) AS INTEGER) AS bytes, md5(reverse(text)) AS rev, repeat(lang, 3) AS rep, md5(translate(text, 'aeiou', 'AEIOU')) AS tr, CAST(ascii(lang) AS INTEGER) AS a, chr(ascii(lang)) AS c,
  CAST(CASE WHEN len(string_split(text, 'e')) - 1 >= 3 THEN length(string_split(text, 'e')[1] || 'e' || string_split(text, 'e')[2] || 'e' || string_split(text, 'e')[3]) + 1 ELSE 0 END AS INTEGER) AS third_e FROM documents""")
def text_positions(t):
    x, lang = F.col("text"), F.col("lang")
    return t.documents.select("doc_id", F.substring(x, 2, 5).alias("sub"), F.instr(x, "the").alias("at"), F.octet_length(x).alias("bytes"), F.md5(F.reverse(x)).alias("rev"), F.repeat(lang, 3).alias("rep"), F.md5(F.translate(x, "aeiou", "AEIOU")).alias("tr"),
                              F.ascii(lang).alias("a"), F.char(F.ascii(lang)).alias("c"), s.nth_position(x, "e", 3).alias("third_e"))


@query("F7", sql="""
SELECT page_id, split_part(url, '/', 3) AS host, CAST(len(string_split(url, '/')) AS INTEGER) AS parts, left(url, 8) AS l, right(url, 4) AS r, contains(url, 'example') AS has, starts_with(url, 'https') AS secure, suffix(url, '#top') AS top FROM pages""")
def text_split_and_tests(t):
    u = F.col("url")
    return t.pages.select("page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), F.size(F.split(u, "/")).alias("parts"), F.left(u, F.lit(8)).alias("l"), F.right(u, F.lit(4)).alias("r"), F.contains(u, F.lit("example")).alias("has"), F.startswith(u, F.lit("https")).alias("secure"), F.endswith(u, F.lit("#top")).alias("top"))


@query("F8", sql="SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def text_distance(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


def sql_soundex(c: str) -> str:
    """Soundex in SQL: H and W are skipped, equal neighbours collapse, vowels and other characters separate."""
    codes = f"translate(replace(replace(upper({c}), 'H', ''), 'W', ''), 'ABCDEFGIJKLMNOPQRSTUVXYZ 01', '012301202245501262301202000')"
    for digit in "123456":
        codes = f"regexp_replace({codes}, '{digit}+', '{digit}', 'g')"
    rest = f"CASE WHEN upper({c})[1] IN ('H', 'W') THEN {codes} ELSE substring({codes}, 2) END"
    return f"left(upper({c})[1] || replace({rest}, '0', '') || '000', 4)"


def _likeness(a: str, b: str) -> str:
    return " + ".join(f"CAST({a}[{i}] = {b}[{i}] AS INTEGER)" for i in range(1, 5))


@query("F8", sql=f"SELECT p_partkey, code, {_likeness('code', 'other')} AS likeness FROM (SELECT p_partkey, {sql_soundex('p_name')} AS code, {sql_soundex('p_type')} AS other FROM part)")
def text_soundex(t):
    return t.part.select("p_partkey", F.soundex("p_name").alias("code"), s.soundex_difference("p_name", "p_type").alias("likeness"))


@query("F9", sql="SELECT COUNT(*) AS n, true AS same_day, true AS after_events FROM events")
def current_moments(t):
    same = F.current_date() == F.to_date(F.current_timestamp())
    later = F.localtimestamp() > F.col("ts")
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.bool_and(same).alias("same_day"), F.bool_and(later & F.date_format(F.current_timestamp(), "HH:mm:ss").rlike(r"^\d\d:\d\d:\d\d$")).alias("after_events"))


@query("F10", sql=f"""
SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s,
  CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(week(ts) AS INTEGER) AS wk, CAST(isoyear(ts) AS INTEGER) AS iso, dayname(ts)[1:3] AS dn, monthname(ts)[1:3] AS mn, {sql_day('last_day(ts)')} AS last, {sql_day("date_trunc('month', ts)")} AS first,
  CAST(millisecond(ts) % 1000 AS INTEGER) AS ms FROM events""")
def date_parts(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.year(ts).alias("y"), F.quarter(ts).alias("q"), F.month(ts).alias("mo"), F.dayofmonth(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), F.dayofweek(ts).alias("dow"),
                           F.dayofyear(ts).alias("doy"), F.weekofyear(ts).alias("wk"), s.iso_year(ts).alias("iso"), F.dayname(ts).alias("dn"), F.monthname(ts).alias("mn"), day(F.last_day(ts)).alias("last"), day(F.trunc(ts, "month")).alias("first"),
                           F.floor(F.extract(F.lit("SECOND"), ts) * 1000 % 1000).cast("int").alias("ms"))


@query("F11", sql=f"""
SELECT o_orderkey, {sql_day("o_orderdate + INTERVAL 5 DAY")} AS plus5, {sql_day("o_orderdate - INTERVAL 5 DAY")} AS minus5, {sql_day("o_orderdate + INTERVAL 1 MONTH")} AS next_month, {sql_day("o_orderdate + INTERVAL 2 YEAR")} AS in2y,
  strftime(o_orderdate + INTERVAL 30 HOUR, '%Y-%m-%d %H:%M:%S') AS plus30h, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS days, CAST(date_sub('month', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS months,
  CAST(date_sub('hour', TIMESTAMP '1995-01-01 12:00:00', o_orderdate) AS BIGINT) AS hours, CAST(date_sub('second', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS secs FROM orders""")
def date_arithmetic(t):
    d = F.col("o_orderdate")
    start = F.lit("1995-01-01").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", day(F.date_add(d, 5)).alias("plus5"), day(F.date_sub(d, 5)).alias("minus5"), day(F.add_months(d, 1)).alias("next_month"), day(d + F.expr("INTERVAL 2 YEARS")).alias("in2y"),
                           F.date_format(d + F.expr("INTERVAL 30 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("plus30h"), F.datediff(d, start).alias("days"), F.timestamp_diff("MONTH", start, d).alias("months"),
                           F.timestamp_diff("HOUR", F.lit("1995-01-01 12:00:00").cast("timestamp_ntz"), d).alias("hours"), F.timestamp_diff("SECOND", start, d).alias("secs"))


@query("F12", sql="""
SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS d, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, strftime(date_trunc('month', ts), '%Y-%m-%d') AS m, strftime(date_trunc('quarter', ts), '%Y-%m-%d') AS q, strftime(date_trunc('year', ts), '%Y-%m-%d') AS y,
  strftime(make_timestamp((epoch_us(ts) + 450000000) // 900000000 * 900000000), '%Y-%m-%d %H:%M:%S') AS quarter_hour FROM events""")
def date_truncation(t):
    cut = lambda u, f="yyyy-MM-dd": F.date_format(F.date_trunc(u, "ts"), f)
    return t.events.select("event_id", cut("day", "yyyy-MM-dd HH:mm").alias("d"), cut("week").alias("w"), cut("month").alias("m"), cut("quarter").alias("q"), cut("year").alias("y"),
                           F.date_format(s.round_time("ts", 900), "yyyy-MM-dd HH:mm:ss").alias("quarter_hour"))


@query("F13", sql=f"""
SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS text, epoch_us(ts) // 1000000 AS unix, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS new_york,
  {sql_day('make_date(year(ts), month(ts), 1)')} AS made, strftime(make_timestamp(year(ts), 1, 2, 3, 4, 5), '%Y-%m-%d %H:%M:%S') AS made_ts FROM events""")
def date_format_and_zones(t):
    ts = F.col("ts")
    return t.events.select("event_id", F.date_format(ts, "dd.MM.yyyy HH:mm").alias("text"), F.unix_timestamp(ts.cast("timestamp")).alias("unix"), F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("new_york"),
                           day(F.make_date(F.year(ts), F.month(ts), F.lit(1))).alias("made"), F.date_format(F.make_timestamp(F.year(ts), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5)), "yyyy-MM-dd HH:mm:ss").alias("made_ts"))


@query("F14", sql=f"""
SELECT o_orderkey, {sql_day("b + CAST(12 + (CASE WHEN isodow(d) > 5 THEN 4 ELSE isodow(d) - 1 END + 12) // 5 * 2 AS INTEGER)")} AS plus12, CAST(((date_diff('day', DATE '1970-01-05', DATE '2002-01-01') // 7) * 5 + least(date_diff('day', DATE '1970-01-05', DATE '2002-01-01') % 7, 5))
  - ((date_diff('day', DATE '1970-01-05', d) // 7) * 5 + least(date_diff('day', DATE '1970-01-05', d) % 7, 5)) AS BIGINT) AS left_days, CAST((o_orderkey % 5) * 86400 + 7200 AS DOUBLE) AS interval_s
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN isodow(o_orderdate) > 5 THEN CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 5 AS INTEGER) ELSE CAST(o_orderdate AS DATE) END AS b FROM orders)""")
def intervals_and_business_days(t):
    iv = F.make_dt_interval((F.col("o_orderkey") % 5).cast("int"), F.lit(2), F.lit(0), F.lit(0.0))
    return t.orders.select("o_orderkey", day(s.add_business_days("o_orderdate", 12)).alias("plus12"), s.business_days_between("o_orderdate", F.lit("2002-01-01").cast("date")).cast("bigint").alias("left_days"), s.interval_seconds(iv).cast("double").alias("interval_s"))


@query("F15", sql="""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, TRY_CAST(o_orderpriority AS DOUBLE) AS nope, CASE WHEN o_custkey = 0 THEN NULL ELSE o_totalprice / o_custkey END AS safe, lower(hex(o_orderkey)) AS h, bin(o_orderkey) AS b2, to_base64(encode(o_orderpriority)) AS b64, o_orderpriority AS back FROM orders""")
def conversions(t):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return t.orders.select("o_orderkey", k.cast("string").alias("text"), p.try_cast("double").alias("nope"), F.try_divide("o_totalprice", F.col("o_custkey")).alias("safe"), F.lower(F.conv(k.cast("string"), 10, 16)).alias("h"), F.conv(k.cast("string"), 10, 2).alias("b2"),
                           F.base64(p).alias("b64"), F.unbase64(F.base64(p)).cast("string").alias("back"))


@query("F16", sql="""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS side, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS code, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS chosen,
  (c_acctbal > 0 AND NOT c_nationkey = 3) OR c_mktsegment = 'FURNITURE' AS logic FROM customer""")
def branching_functions(t):
    b, n, m = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.when(b > 0, "credit").otherwise("debit").alias("side"), s.decode(m, {"BUILDING": "B", "MACHINERY": "M"}, "?").alias("code"), F.when(n > 0, s.choose(F.greatest(n, F.lit(1)), "one", "two", "three")).alias("chosen"),
                             (((b > 0) & ~(n == 3)) | (m == "FURNITURE")).alias("logic"))


@query("F17", sql="""
SELECT o_orderkey, coalesce(p, s, 'x') AS c, coalesce(p, 'none') AS n, nullif(s, 'F') AS nf, CASE WHEN p IS NOT NULL THEN 'known' ELSE 'missing' END AS n2, p IS NULL AS isnull FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def null_functions(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"), F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return df.select("o_orderkey", F.coalesce("p", "s", F.lit("x")).alias("c"), F.nvl("p", F.lit("none")).alias("n"), F.nullif("s", F.lit("F")).alias("nf"), F.nvl2("p", F.lit("known"), F.lit("missing")).alias("n2"), F.isnull("p").alias("isnull"))


@query("F19", sql="SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 0 WHEN o_totalprice >= 401000 THEN 11 ELSE CAST(floor((o_totalprice - 1000) / 40000) AS BIGINT) + 1 END AS bucket FROM orders")
def width_buckets(t):
    return t.orders.select("o_orderkey", F.width_bucket("o_totalprice", F.lit(1000.0), F.lit(401000.0), F.lit(10)).alias("bucket"))


@query("F20", sql="""
SELECT c_custkey, c_name || '/' || c_mktsegment AS c, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'z') AS cw, repeat('ab', CAST(c_nationkey AS BIGINT)) AS r, printf('%05d|%s', c_custkey, c_mktsegment) AS f, array_to_string([c_mktsegment, 'x', c_name], '+') AS a FROM customer""")
def text_assembly(t):
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("c"), F.concat_ws("-", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("z")).alias("cw"), F.repeat(F.lit("ab"), F.col("c_nationkey")).alias("r"),
                             F.format_string("%05d|%s", "c_custkey", "c_mktsegment").alias("f"), F.array_join(F.array("c_mktsegment", F.lit("x"), "c_name"), "+").alias("a"))


@query("F21", sql=r"""
SELECT doc_id, regexp_matches(text, '\b[Tt]he\b') AS has_the, regexp_extract(text, '(\w+)@(\w+)', 2) AS at_host, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS numbers, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, md5(array_to_string(regexp_extract_all(text, '[0-9]+'), ',')) AS listed FROM documents""")
def regular_expressions(t):
    x = F.col("text")
    return t.documents.select("doc_id", x.rlike(r"\b[Tt]he\b").alias("has_the"), F.regexp_extract(x, r"(\w+)@(\w+)", 2).alias("at_host"), F.regexp_count(x, F.lit("[0-9]+")).alias("numbers"), F.md5(F.regexp_replace(x, "[0-9]+", "#")).alias("masked"),
                              F.md5(F.array_join(F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)), ",")).alias("listed"))


@query("F21", sql=r"""
SELECT page_id, CAST(coalesce(nullif(strpos(url, regexp_extract(url, '[0-9]+')), 1), 0) AS INTEGER) AS first_digit, array_to_string(string_split_regex(url, '[/?#]+'), '|') AS pieces, regexp_extract(url, '^(?P<scheme>[a-z]+)://(?P<host>[^/]+)', 2) AS host FROM pages""")
def regex_positions_and_groups(t):
    u = F.col("url")
    return t.pages.select("page_id", F.regexp_instr(u, F.lit("[0-9]+")).alias("first_digit"), F.array_join(F.split(u, "[/?#]+"), "|").alias("pieces"), F.regexp_extract(u, r"^(?<scheme>[a-z]+)://(?<host>[^/]+)", 2).alias("host"))


ORDER_LINES = "(SELECT l_orderkey, list_sort(list(l_linenumber)) AS ln, list_sort(list(DISTINCT CAST(l_quantity AS INTEGER))) AS q FROM lineitem GROUP BY 1)"
text_list = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _order_lines(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ln"), F.array_sort(F.collect_set(F.col("l_quantity").cast("int"))).alias("q"))


@query("F22", sql=f"""
SELECT l_orderkey, CAST(len(ln) AS INTEGER) AS size, ln[1] AS head, ln[9] AS ninth, array_to_string(list_append(ln, 99), ',') AS appended, array_to_string(list_prepend(0, ln), ',') AS prepended, array_to_string(list_concat(ln, q), ',') AS joined, list_contains(q, 10) AS has10,
  array_to_string(list_sort(list_distinct(ln)), ',') AS uniq, array_to_string(list_filter(ln, lambda x: x != 1), ',') AS no1, array_to_string(list_reverse_sort(ln), ',') AS down, array_to_string(flatten([ln, q]), ',') AS flat, array_to_string(ln[2:3], ',') AS mid FROM {ORDER_LINES}""")
def array_functions(t):
    ln, q = F.col("ln"), F.col("q")
    return _order_lines(t).select("l_orderkey", F.size(ln).alias("size"), F.element_at(ln, 1).alias("head"), F.try_element_at(ln, F.lit(9)).alias("ninth"), text_list(F.array_append(ln, 99)).alias("appended"), text_list(F.array_prepend(ln, 0)).alias("prepended"),
                                  text_list(F.concat(ln, q)).alias("joined"), F.array_contains(q, 10).alias("has10"), text_list(F.array_sort(F.array_distinct(ln))).alias("uniq"), text_list(F.array_remove(ln, 1)).alias("no1"),
                                  text_list(F.sort_array(ln, False)).alias("down"), text_list(F.flatten(F.array(ln, q))).alias("flat"), text_list(F.slice(ln, 2, 2)).alias("mid"))


@query("F23", "F32", sql=f"""
SELECT l_orderkey, array_to_string(list_transform(ln, lambda x: x * 2), ',') AS doubled, array_to_string(list_filter(q, lambda x: x > 25), ',') AS large, CAST(list_sum(ln) AS INTEGER) AS total, array_to_string(list_sort(list_intersect(ln, q)), ',') AS both,
  array_to_string(list_sort(list_distinct(list_concat(ln, q))), ',') AS any_of, array_to_string(list_sort(list_distinct(list_filter(ln, lambda x: NOT list_contains(q, x)))), ',') AS only_ln, len(list_filter(ln, lambda x: x > 6)) > 0 AS some_7, len(list_filter(q, lambda x: x <= 0)) = 0 AS all_pos,
  array_to_string(range(1, len(ln) + 1), ',') AS seq, array_to_string(list_transform(range(1, len(ln) + 1), lambda i: ln[i] + i), ',') AS zipped FROM {ORDER_LINES}""")
def array_higher_order(t):
    ln, q = F.col("ln"), F.col("q")
    index = F.sequence(F.lit(1), F.size(ln))
    return _order_lines(t).select("l_orderkey", text_list(F.transform(ln, lambda x: x * 2)).alias("doubled"), text_list(F.filter(q, lambda x: x > 25)).alias("large"), F.aggregate(ln, F.lit(0), lambda a, x: a + x).alias("total"), text_list(F.array_sort(F.array_intersect(ln, q))).alias("both"),
                                  text_list(F.array_sort(F.array_union(ln, q))).alias("any_of"), text_list(F.array_sort(F.array_except(ln, q))).alias("only_ln"), F.exists(ln, lambda x: x > 6).alias("some_7"), F.forall(q, lambda x: x > 0).alias("all_pos"),
                                  text_list(index).alias("seq"), text_list(F.zip_with(ln, index, lambda a, b: a + b)).alias("zipped"))


@query("F24", sql="""
SELECT c_custkey, 'name,nation' AS keys, c_name || ',' || CAST(c_nationkey AS VARCHAR) AS vals, c_name AS got, true AS has, CAST(NULL AS VARCHAR) AS missing, c_name || ',' || CAST(c_nationkey AS VARCHAR) || ',' || c_mktsegment AS merged, CAST(c_nationkey AS VARCHAR) AS filtered, upper(c_name) AS upped FROM customer""")
def map_functions(t):
    m = F.map_from_arrays(F.array(F.lit("name"), F.lit("nation")), F.array("c_name", F.col("c_nationkey").cast("string")))
    more = F.map_concat("m", F.map_from_entries(F.array(F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v")))))
    return t.customer.withColumn("m", m).select("c_custkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.array_join(F.map_values("m"), ",").alias("vals"), F.element_at("m", "name").alias("got"), F.map_contains_key("m", "nation").alias("has"),
                                                F.try_element_at("m", F.lit("zip")).alias("missing"), F.array_join(F.map_values(more), ",").alias("merged"), F.array_join(F.map_values(F.map_filter("m", lambda k, v: k == "nation")), ",").alias("filtered"),
                                                F.element_at(F.transform_values("m", lambda k, v: F.upper(v)), "name").alias("upped"))


@query("F25", sql="""
SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(props->>'$.k' AS INTEGER) AS parsed, json_exists(props, '$.z') AS has_z, true AS valid, 'k' AS keys, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS made FROM events""")
def json_functions(t):
    p = F.col("props")
    return t.events.select("event_id", F.get_json_object(p, "$.k").cast("int").alias("k"), F.from_json(p, "k INT")["k"].alias("parsed"), F.get_json_object(p, "$.z").isNotNull().alias("has_z"), F.try_parse_json(p).isNotNull().alias("valid"),
                           F.array_join(F.json_object_keys(p), ",").alias("keys"), F.to_json(F.struct("event_id", "event_type")).alias("made"))


@query("F25", sql="SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q FROM lineitem")
def json_rows(t):
    """Rows gathered per order into a JSON array and parsed back into rows."""
    packed = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")))).alias("j"))
    return packed.select("l_orderkey", F.explode(F.from_json("j", "array<struct<n: int, q: double>>")).alias("x")).select("l_orderkey", F.col("x.n").alias("l_linenumber"), F.col("x.q").alias("q"))


@query("F26", sql="SELECT n_nationkey, n_name AS name, n_regionkey AS region, n_name AS by_path, n_regionkey AS path_int FROM nation")
def xml_functions(t):
    x = F.concat(F.lit("<n><name>"), "n_name", F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></n>"))
    df = t.nation.withColumn("x", x).withColumn("p", F.from_xml("x", "name STRING, region INT"))
    return df.select("n_nationkey", F.col("p.name").alias("name"), F.col("p.region").alias("region"), F.xpath_string("x", F.lit("n/name")).alias("by_path"), F.xpath_int("x", F.lit("n/region")).alias("path_int"))


@query("F27", sql="""
SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2, to_base64(encode(lang)) AS b64, url_encode(source || '/é ') AS enc, source AS dec, true AS uuid_form FROM documents""")
def hashes_and_encodings(t):
    x = F.col("text")
    enc = F.regexp_replace(F.url_encode(F.concat("source", F.lit("/é "))), r"\+", "%20")
    return t.documents.select("doc_id", F.md5(x).alias("m"), F.sha1(x).alias("s1"), F.sha2(x, 256).alias("s2"), F.base64("lang").alias("b64"), enc.alias("enc"), F.url_decode(F.url_encode("source")).alias("dec"),
                              F.uuid().rlike("^[0-9a-f-]{36}$").alias("uuid_form"))


@query("F27", sql="SELECT COUNT(*) AS n, COUNT(DISTINCT text) AS texts, true AS crc_separates, true AS hash_separates FROM documents")
def checksum_functions(t):
    a = t.documents.select("text", F.crc32("text").alias("c"), F.xxhash64("text").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"), F.count_distinct("c").alias("c"), F.count_distinct("h").alias("h"))
    return a.select("n", "texts", (F.col("c") >= F.col("texts") * 0.999).alias("crc_separates"), (F.col("h") == F.col("texts")).alias("hash_separates"))


@query("F29", sql=r"""
SELECT doc_id, md5(regexp_replace(text, '[ \n\t\r]+', '', 'g')) AS packed, md5(translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')) AS plain FROM documents""")
def text_cleanup(t):
    return t.documents.select("doc_id", F.md5(s.remove_spaces("text")).alias("packed"), F.md5(s.remove_diacritics("text")).alias("plain"))


@query("F29", sql=r"""
SELECT p_partkey, regexp_replace(p_brand, '[^a-zA-Z0-9 ]', '', 'g') AS letters, lower(replace(p_name, ' ', '_')) AS snake, lower(split_part(p_name, ' ', 1)) || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS camel FROM part""")
def text_case_styles(t):
    return t.part.select("p_partkey", s.remove_special("p_brand").alias("letters"), s.to_snake_case("p_name").alias("snake"), s.to_camel_case("p_name").alias("camel"))


@query("F30", sql=f"""
SELECT o_orderkey, {sql_day("d + CAST(CASE WHEN isodow(d) = 1 THEN 7 ELSE 8 - isodow(d) END AS INTEGER)")} AS next_monday, isodow(d) > 5 AS weekend, isodow(d) <= 5 AS business, CAST(year(d) + CASE WHEN month(d) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal,
  CAST(({{m}}) // 12 AS INTEGER) AS age_y, CAST(({{m}}) % 12 AS INTEGER) AS age_m FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '2002-01-15' AS e FROM orders)""".replace("{m}", "(year(e) - year(d)) * 12 + month(e) - month(d) - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END"))
def calendar_helpers(t):
    d = F.col("o_orderdate")
    age = s.age_parts(d, F.lit("2002-01-15").cast("date"))
    return t.orders.select("o_orderkey", day(F.next_day(d, "Mon")).alias("next_monday"), s.is_weekend(d).alias("weekend"), s.is_business_day(d).alias("business"), s.fiscal_year(d, 4).alias("fiscal"), age["years"].alias("age_y"), age["months"].alias("age_m"))


@query("F32", sql="SELECT c_custkey, c_name || ',' || c_mktsegment AS csv, c_name AS back, true AS has_file, true AS has_partition FROM customer")
def csv_and_file_functions(t):
    df = t.customer.withColumn("csv", F.to_csv(F.struct("c_name", "c_mktsegment")))
    return df.select("c_custkey", "csv", F.from_csv("csv", "name STRING, segment STRING")["name"].alias("back"), F.input_file_name().endswith("customer.parquet").alias("has_file"), (F.spark_partition_id() >= 0).alias("has_partition"))
