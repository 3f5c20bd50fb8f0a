"""Percentiles over moving frames against brute force, whole and cut."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import orderstats
from millrace.operators.windows import UNBOUNDED, Frame

SCHEMA = "id bigint, g string, at int, day date, v double, extra string, __x int"


def quantile(values, p, continuous=True):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    if not values:
        return None
    if not continuous:
        return values[max(math.ceil(p * len(values)), 1) - 1]
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def by_force(rows, frame, keyed, descending=False):
    groups, out = {}, {}
    for r in rows:
        groups.setdefault(r[1] if keyed else 0, []).append(r)
    for group in groups.values():
        group = sorted(group, key=lambda r: ((r[2] is not None) != descending, (r[2] or 0) * (-1 if descending else 1), r[0]))
        for i, r in enumerate(group):
            if frame.kind == "rows":
                lo = 0 if frame.start == UNBOUNDED else max(0, i + frame.start)
                hi = len(group) if frame.end == UNBOUNDED else max(0, i + frame.end + 1)
                seen = group[lo:hi]
            elif r[2] is None:
                seen = [x for x in group if x[2] is None or (descending and frame.start == UNBOUNDED) or (not descending and frame.end == UNBOUNDED)]
            else:
                sign = -1 if descending else 1
                seen = [x for x in group if x[2] is not None and (frame.start == UNBOUNDED or (x[2] - r[2]) * sign >= frame.start) and (frame.end == UNBOUNDED or (x[2] - r[2]) * sign <= frame.end)]
            v = [x[4] for x in seen]
            out[r[0]] = (quantile(v, 0.5), quantile(v, 0.9), quantile(v, 0.3, False))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(4), []
    for i in range(700):
        at = None if i % 29 == 0 else rnd.randrange(60)
        out.append((i, None if i % 5 == 0 else "ab"[i % 3 == 0], at, None, None if i % 13 == 0 else float(rnd.randrange(40)), "x", i))
    return out


FRAMES = {"rows_back": Frame("rows", -6, 0), "rows_ahead": Frame("rows", 2, 9), "rows_behind": Frame("rows", -9, -3), "wide": Frame("rows", -200, 150), "range": Frame("range", -5, 2), "range_ahead": Frame("range", 1, 4), "peers": Frame("range", 0, 0)}


@pytest.mark.parametrize("limit", [10_000, 40], ids=["whole", "cut"])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("name", FRAMES)
def test_moving_percentiles(spark, rows, name, keyed, limit):
    df = spark.createDataFrame(rows, SCHEMA)
    frame, descending = FRAMES[name], name in ("range", "rows_back")
    order = [("at", "desc" if descending else "asc"), "id"] if frame.kind == "rows" else [("at", "desc" if descending else "asc")]
    got = orderstats.moving_quantiles(df, {"m": 0.5, "p": 0.9, "d": (0.3, "disc")}, "v", partition_by=["g"] if keyed else [], order_by=order, frame=frame, max_group_rows=limit)
    assert got.columns == [*df.columns, "m", "p", "d"]
    got = {r["id"]: (r["m"], r["p"], r["d"]) for r in got.collect()}
    want = by_force(rows, frame, keyed, descending)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i]), (i, got[i], want[i])


@pytest.mark.parametrize("frame", [Frame("rows", UNBOUNDED, 0), Frame("rows", 0, UNBOUNDED), Frame("rows", UNBOUNDED, UNBOUNDED)])
def test_frames_open_at_an_end(spark, rows, frame):
    df = spark.createDataFrame(rows, SCHEMA)
    got = orderstats.moving_quantiles(df, {"m": 0.5, "p": 0.9, "d": (0.3, "disc")}, "v", partition_by=["g"], order_by=["at", "id"], frame=frame)
    want = by_force(rows, frame, True)
    assert {r["id"]: (r["m"], r["p"], r["d"]) for r in got.collect()} == {i: pytest.approx(w) for i, w in want.items()}
    with pytest.raises(ValueError):
        orderstats.moving_median(df, "v", "m", partition_by=["g"], order_by=["at", "id"], frame=frame, max_group_rows=40)


def test_dates_empty_tables_and_groups_that_span_batches(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("at")))
    by = lambda column, d: {r["id"]: r["m"] for r in orderstats.moving_median(d, "v", "m", partition_by=["g"], order_by=[column], frame=Frame("range", -3, 3)).collect()}
    want = by("at", df)
    assert by("day", df) == want
    monkeypatch.setattr(orderstats, "HELD_ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert by("at", df) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert by("at", df.limit(0)) == {}


def test_rank_tree_selects_any_stretch():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300):
        v = rng.integers(0, 9, n).astype(float)
        lo = rng.integers(0, n, 500)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 500))
        k = (rng.random(500) * (hi - lo)).astype(int)
        assert orderstats.RankTree(v).kth(lo, hi, k).tolist() == [sorted(v[a:b])[c] for a, b, c in zip(lo, hi, k)]
    assert all(c.mask.all() for c in orderstats.quantiles(np.array([np.nan, np.nan]), np.array([0, 1]), np.array([2, 1]), [(0.5, True), (0.5, False)]))


@pytest.mark.parametrize("held", [1, 64, 1 << 30])
@pytest.mark.parametrize("start, end", [(-6, 0), (2, 9), (-9, -3), (-40, 30), (0, 0), (None, 2), (-3, None), (None, None)])
@pytest.mark.parametrize("by_value", [True, False])
def test_rows_are_answered_as_their_frames_come_in(monkeypatch, by_value, start, end, held):
    """Whatever is held back, each own row gets the percentiles of its frame; bounded frames never hold a whole group."""
    rnd = random.Random(7)
    groups = {g: sorted((None if rnd.random() < 0.01 else rnd.randrange(300) for _ in range(n)), key=lambda x: (x is None, x)) for g, n in ((5, 600), (9, 3), (2, 100))}
    rows = [{"id": 10_000 * g + i, "__group": g, "__mine": rnd.random() < 0.8, "__place": place if by_value else i, "__value": rnd.choice([None, float(rnd.randrange(50))])}
            for g, places in groups.items() for i, place in enumerate(places)]
    schema = pa.schema([("id", pa.int64()), ("__group", pa.int64()), ("__mine", pa.bool_()), ("__place", pa.int64()), ("__value", pa.float64())])
    batches = [pa.RecordBatch.from_pylist(rows[i:i + 17], schema) for i in range(0, len(rows), 17)]
    sizes, tree = [], orderstats.RankTree
    monkeypatch.setattr(orderstats, "HELD_ROWS", held)
    monkeypatch.setattr(orderstats, "RankTree", lambda values: sizes.append(len(values)) or tree(values))
    found = orderstats._answered([(0.5, True), (0.3, False)], ["id"], start, end, by_value, ["m", "d"])(iter(batches))
    got = [(r["id"], r["m"], r["d"]) for b in found for r in b.to_pylist()]
    want = []
    for r in (r for r in rows if r["__mine"]):
        group, at = [x for x in rows if x["__group"] == r["__group"]], r["__place"]
        # Places are positions without by_value. Rows without a place are peers of each other and come last.
        inside = lambda x: (x["__place"] is None or x["__place"] >= at + start) if start is not None else True
        before = lambda x: (x["__place"] is not None and x["__place"] <= at + end) if end is not None else True
        if at is None:
            inside, before = (lambda x: start is None or x["__place"] is None), (lambda x: True)
        v = [x["__value"] for x in group if inside(x) and before(x)]
        want.append((r["id"], quantile(v, 0.5), quantile(v, 0.3, False)))
    assert got == [(i, m and pytest.approx(m), d) for i, m, d in want]
    if held < 1000 and start is not None and end is not None:
        assert max(sizes) < 220
