"""The cut evaluation of windows must equal Spark's own window, whatever the group sizes."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import scaling, windows
from millrace.operators.aggregates import exact_percentiles, spearman
from millrace.operators.merge import surrogate_key
from millrace.operators.windows import Frame, WindowFn

PLAIN, CUT = None, 60


@pytest.fixture(scope="module")
def hot(t):
    """Events where one user owns a third of the rows, with NULLs among keys, order and values."""
    e = t.events.withColumn("price", F.col("value").cast("decimal(15,2)"))
    return e.select(
        "event_id", "ts", "event_type",
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id") % 5).alias("user"),
        F.when(F.col("event_type") != "error", F.col("price")).alias("price"),
        F.when(F.col("event_id") % 11 != 0, (F.col("value") / 5).cast("int")).alias("band"),
    ).cache()


CASES = {
    "ranks": ([WindowFn("rank", "a"), WindowFn("dense_rank", "b"), WindowFn("percent_rank", "c"), WindowFn("cume_dist", "d")], [("band", "desc")], None),
    "ranks_nulls_last": ([WindowFn("rank", "a"), WindowFn("dense_rank", "b")], [("band", "asc", "last"), "event_type"], None),
    "numbers": ([WindowFn("row_number", "a"), WindowFn("ntile", "b", n=7)], ["band", ("event_id", "desc")], None),
    "tiles_wider_than_groups": ([WindowFn("ntile", "b", n=5000)], ["event_id"], None),
    "offsets": ([WindowFn("lag", "a", "price", offset=3), WindowFn("lead", "b", "event_type", default="none")], ["ts", "event_id"], None),
    "running_rows": ([WindowFn("sum", "a", "price"), WindowFn("count", "b", "price"), WindowFn("avg", "c", "price"), WindowFn("min", "d", "price"), WindowFn("max", "e", "price")],
                     ["ts", "event_id"], windows.RUNNING_ROWS),
    "running_peers": ([WindowFn("sum", "a", "price"), WindowFn("count", "b")], ["band"], windows.RUNNING_RANGE),
    "default_frame": ([WindowFn("sum", "a", "price")], ["band"], None),
    "sliding_rows": ([WindowFn("sum", "a", "price"), WindowFn("first", "b", "event_type"), WindowFn("max", "c", "price")], ["ts", "event_id"], Frame("rows", -5, 2)),
    "ahead_rows": ([WindowFn("sum", "a", "price")], ["ts", "event_id"], Frame("rows", 1, 4)),
    "sliding_range": ([WindowFn("sum", "a", "price"), WindowFn("count", "b")], ["band"], Frame("range", -4, 3)),
    "sliding_range_desc": ([WindowFn("sum", "a", "price")], [("band", "desc")], Frame("range", -4, 3)),
    "carried": ([WindowFn("last", "a", "price"), WindowFn("first", "b", "price")], ["ts", "event_id"], windows.RUNNING_ROWS),
    "carried_with_nulls": ([WindowFn("last", "a", "price", ignore_nulls=False), WindowFn("first", "b", "price", ignore_nulls=False)], ["ts", "event_id"], windows.RUNNING_ROWS),
    "whole": ([WindowFn("sum", "a", "price"), WindowFn("max", "b", "band")], [], None),
    "open_end": ([WindowFn("sum", "a", "price"), WindowFn("count", "b", "price")], ["ts", "event_id"], Frame("rows", -2, "unbounded")),
    "open_end_ahead": ([WindowFn("sum", "a", "price"), WindowFn("count", "b")], ["ts", "event_id"], Frame("rows", 3, "unbounded")),
    "open_start_ahead": ([WindowFn("max", "a", "price"), WindowFn("count", "b")], ["ts", ("event_id", "desc")], Frame("rows", "unbounded", 2)),
    "open_start_behind": ([WindowFn("sum", "a", "price"), WindowFn("count", "b")], ["ts", "event_id"], Frame("rows", "unbounded", -4)),
    "picks_of_whole": ([WindowFn("first", "a", "price"), WindowFn("last", "b", "price"), WindowFn("nth_value", "c", "price", offset=4), WindowFn("first", "d", "price", ignore_nulls=False)], ["ts", "event_id"], windows.WHOLE),
    "open_range_end": ([WindowFn("sum", "a", "price"), WindowFn("count", "b"), WindowFn("avg", "c", "price"), WindowFn("min", "d", "price")], ["band"], Frame("range", -2, "unbounded")),
    "open_range_end_ahead": ([WindowFn("count", "b", "price"), WindowFn("max", "d", "price")], ["band"], Frame("range", 3, "unbounded")),
    "open_range_start": ([WindowFn("sum", "a", "price"), WindowFn("count", "b")], [("band", "desc")], Frame("range", "unbounded", 3)),
    "open_range_start_behind": ([WindowFn("sum", "a", "price"), WindowFn("count", "b"), WindowFn("max", "c", "band")], [("band", "asc", "last")], Frame("range", "unbounded", -2)),
    "range_to_the_end": ([WindowFn("sum", "a", "price"), WindowFn("last", "b", "band")], ["band"], Frame("range", 0, "unbounded")),
    "picks_of_ranges": ([WindowFn("first", "a", "band"), WindowFn("last", "b", "band"), WindowFn("last", "c", "band", ignore_nulls=False)], [("band", "desc", "first")], windows.RUNNING_RANGE),
    "picks_of_default_frame": ([WindowFn("last", "b", "band"), WindowFn("rank", "r")], ["band"], None),
    "picks_of_open_ranges": ([WindowFn("first", "a", "band"), WindowFn("last", "b", "band", ignore_nulls=False)], ["band"], Frame("range", -3, "unbounded")),
    "spreads_of_rows": ([WindowFn("stddev", "a", "band"), WindowFn("var_pop", "b", "band"), WindowFn("collect_list", "c", "event_type")], ["ts", "event_id"], Frame("rows", -3, 1)),
    "spreads_of_ranges": ([WindowFn("variance", "a", "band")], ["band"], Frame("range", -2, 2)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("keys", [["user"], []], ids=["key", "global"])
def test_cut_equals_plain(hot, rows_of, name, keys):
    functions, order, frame = CASES[name]
    run = lambda size: windows.window(hot, functions, partition_by=keys, order_by=order, frame=frame, max_group_rows=size).select("event_id", *[f.alias for f in functions])
    plain, cut = run(PLAIN), run(CUT)
    assert [(f.name, f.dataType) for f in cut.schema] == [(f.name, f.dataType) for f in plain.schema]
    cut, plain = rows_of(cut), rows_of(plain)
    assert len(cut) == hot.count() and cut == plain


def test_cut_when_hot_keys_cannot_be_listed(hot, rows_of, monkeypatch):
    from millrace.operators import sizing
    monkeypatch.setattr(sizing, "MAX_LISTED_GROUPS", 1)
    run = lambda size: rows_of(windows.window(hot, [WindowFn("rank", "a"), WindowFn("lag", "b", "band")], partition_by=["user"], order_by=["ts", "event_id"], max_group_rows=size).select("event_id", "a", "b"))
    assert run(20) == run(PLAIN)


def test_all_sort_keys_equal_stays_right(hot, rows_of):
    same = hot.withColumn("k", F.lit(1))
    run = lambda size: rows_of(windows.window(same, [WindowFn("rank", "a"), WindowFn("cume_dist", "b")], order_by=["k"], max_group_rows=size).select("event_id", "a", "b"))
    assert run(CUT) == run(PLAIN)


def test_sessions_and_fills_on_hot_user(hot, rows_of):
    s = lambda size: rows_of(windows.session_summary(hot, user=["user"], ts="ts", gap_seconds=3600, tie_breaker=["event_id"], max_group_rows=size))
    assert s(CUT) == s(PLAIN)
    f = lambda size: rows_of(scaling.fill_along(hot, "price", "backward", partition_by=["user"], order_by=["ts", "event_id"], alias="x", max_group_rows=size).select("event_id", "x"))
    assert f(CUT) == f(PLAIN)
    h = hot.withColumn("pos", F.unix_micros(F.col("ts").cast("timestamp")))
    i = lambda size: rows_of(scaling.interpolate(h, "price", "pos", partition_by=["user"], order_by=["ts", "event_id"], alias="x", max_group_rows=size).select("event_id", F.round("x", 6).alias("x")))
    assert i(CUT) == i(PLAIN)


def test_percentiles_and_spearman_on_hot_groups(hot, rows_of):
    want = rows_of(hot.groupBy("user").agg(F.percentile("band", 0.3).alias("p"), F.percentile("band", 0.5).alias("q")))
    got = rows_of(exact_percentiles(hot, ["user"], "band", {"p": 0.3, "q": 0.5}, max_group_rows=20))
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want]
    a = spearman(hot, "band", "event_id", max_group_rows=20).first()[0]
    b = spearman(hot, "band", "event_id", max_group_rows=None).first()[0]
    assert a == pytest.approx(b)


def test_surrogate_keys_have_no_gaps(hot):
    keyed = surrogate_key(hot, "sk", "row_number", order_by=["ts", "event_id"], start=5, max_group_rows=CUT)
    lo, hi, n = keyed.agg(F.min("sk"), F.max("sk"), F.count_distinct("sk")).first()
    assert (lo, hi, n) == (5, 4 + hot.count(), hot.count())


def test_ranking_ignores_a_custom_frame(hot):
    out = windows.window(hot, [WindowFn("rank", "r"), WindowFn("sum", "s", "price")], partition_by=["user"], order_by=["event_id"], frame=windows.RUNNING_ROWS)
    assert out.count() == hot.count()


def few_values(df, share=90):
    """Nine of ten rows have one sort key, the others another or none."""
    return df.withColumn("k", F.when(F.col("event_id") % 100 < share, F.lit(1)).when(F.col("event_id") % 7 != 0, F.col("band")))


@pytest.mark.parametrize("keys", [["user"], []], ids=["key", "global"])
def test_heavy_ties_are_ranked_by_value(hot, rows_of, keys):
    fns = [WindowFn("rank", "a"), WindowFn("dense_rank", "b"), WindowFn("percent_rank", "c"), WindowFn("cume_dist", "d"), WindowFn("sum", "e", "price"), WindowFn("count", "f", "price"), WindowFn("min", "g", "price")]
    run = lambda size, order: windows.window(few_values(hot), fns, partition_by=keys, order_by=order, max_group_rows=size).select("event_id", *"abcdefg")
    for order in (["k"], [("k", "desc", "first")], ["k", ("event_type", "desc")]):
        assert run(CUT, order).dtypes == run(PLAIN, order).dtypes
        assert rows_of(run(CUT, order)) == rows_of(run(PLAIN, order))


def test_rows_among_heavy_ties_are_numbered_once(hot):
    out = windows.window(few_values(hot).drop("event_id", "ts"), [WindowFn("row_number", "n"), WindowFn("ntile", "t", n=4), WindowFn("lag", "p", "k")], order_by=["k"], max_group_rows=CUT)
    n = hot.count()
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, n, n)
    ordered = [r["k"] for r in out.orderBy("n").collect()]
    assert ordered == sorted(ordered, key=lambda k: (k is not None, k or 0)) and [r["p"] for r in out.orderBy("n").collect()][1:] == ordered[:-1]
    sizes = [r["count"] for r in out.groupBy("t").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_no_task_takes_a_heavy_tie(hot):
    out = windows.window(few_values(hot), [WindowFn("rank", "a")], partition_by=["user"], order_by=["k"], max_group_rows=CUT)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        windows.window(hot, [WindowFn("stddev", "a", "band")], partition_by=["user"], order_by=["band"], frame=windows.RUNNING_ROWS, max_group_rows=CUT)
