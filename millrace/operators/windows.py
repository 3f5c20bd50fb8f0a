"""Window functions that survive dominant partitions.

Spark evaluates one window partition inside one task. That is right while partitions are
bounded and fatal when one key owns a third of the table, or when there is no PARTITION BY.
``window`` therefore counts the groups first. Without hot groups the plan is the plain Spark
window. With hot groups they are cut along the sort order:

* chunk pass - a hot group is split at sampled boundaries of its sort key. Equal sort keys stay
  together, so ranks and RANGE frames are right inside a chunk; a summary with one row per
  (key, chunk) carries what the earlier chunks add (row counts, distinct counts, sums, minima).
* block pass - for lag, lead, sliding ROWS frames and running first/last, rows are cut into
  equal blocks of the now known row number. Rows near a border are copied to the neighbour
  block, which then sees all rows its frames need.

* value pass - where a function depends on the sort value alone (RANGE frames open on one side,
  running first/last over RANGE, and ranks or running RANGE aggregates when more rows share one sort
  key than a task should take), the rows are aggregated to one row per (key, sort key) with map-side
  combine, the window runs over those, cut in its turn if it has to be, and its values are joined
  back. The value at a frame bound that no row has is carried from the nearest row before it.

All passes are exact. Boundaries only decide how evenly the work is spread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from millrace.operators.ordering import Sort, as_sorts, sort_columns
from millrace.operators.sizing import MAX_GROUP_ROWS, HotGroups, hot_groups, join_back, row_hash
from millrace.session import materialise

UNBOUNDED = "unbounded"
RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"}
COUNTING = {"row_number", "rank", "dense_rank", "ntile"}      # bigint: a group may hold more than an int can count
OFFSETS = {"lag", "lead"}
AGGREGATES = {"sum", "avg", "min", "max", "count"}
SPREADS = {"stddev", "stddev_pop", "variance", "var_pop", "collect_list"}     # over moving frames; collect_list with as many elements as the frame has rows
PICKS = {"first", "last", "nth_value"}
# Spellings accepted from configuration.
ALIASES = {"first_value": "first", "last_value": "last", "mean": "avg", "stddev_samp": "stddev", "var_samp": "variance", "array_agg": "collect_list"}
MAX_CHUNKS = 8192
SAMPLES_PER_CHUNK = 20
MAX_SUMMARY_ROWS = 200_000


@dataclass(frozen=True)
class WindowFn:
    """One output column. ``offset`` serves lag/lead/nth_value, ``n`` serves ntile."""

    function: str
    alias: str
    column: str | None = None
    offset: int = 1
    default: object = None
    n: int = 4
    ignore_nulls: bool = True

    @property
    def name(self) -> str:
        lowered = self.function.lower()
        return ALIASES.get(lowered, lowered)


@dataclass(frozen=True)
class Frame:
    """``kind`` is "rows" or "range"; ends are signed offsets, or "unbounded"."""

    kind: str = "rows"
    start: int | str = UNBOUNDED
    end: int | str = 0

    def apply(self, spec):
        start = W.unboundedPreceding if self.start == UNBOUNDED else self.start
        end = W.unboundedFollowing if self.end == UNBOUNDED else self.end
        return spec.rowsBetween(start, end) if self.kind == "rows" else spec.rangeBetween(start, end)

    @property
    def whole(self) -> bool:
        return self.start == UNBOUNDED and self.end == UNBOUNDED

    @property
    def running(self) -> bool:
        return self.start == UNBOUNDED and self.end == 0

    @property
    def bounded(self) -> bool:
        return UNBOUNDED not in (self.start, self.end)


RUNNING_RANGE = Frame("range", UNBOUNDED, 0)
RUNNING_ROWS = Frame("rows", UNBOUNDED, 0)
WHOLE = Frame("rows", UNBOUNDED, UNBOUNDED)


def window(
    df: DataFrame,
    functions: Sequence[WindowFn],
    *,
    partition_by: Sequence[str] = (),
    order_by=(),
    frame: Frame | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    counts_from: DataFrame | None = None,
    stable_input: bool = False,
) -> DataFrame:
    """Append window columns.

    ``max_group_rows=None`` skips the check: use it when the data model bounds every group (the
    lines of one order), where one shuffle is all that is needed. ``counts_from`` names a cheaper
    table whose groups are at least as large (the stored table behind an expensive ``df``); it is
    counted first, and ``df`` itself only when that finds a large group. Hot inputs are read several
    times, so they are written to the shared folder once; ``stable_input=True`` says that ``df`` is
    a plain projection of stored tables, which is cheaper to scan again.
    """
    keys, sorts = list(partition_by), as_sorts(order_by)
    if not sorts and (frame is None or frame.whole) and all(f.name in AGGREGATES for f in functions):
        return _totals(df, functions, keys)     # no order: aggregate and join, whatever the group sizes
    if max_group_rows is not None:
        hot = hot_groups(df if counts_from is None else counts_from, keys, max_group_rows, screen=stable_input or counts_from is not None)
        if hot.any:
            df = df if stable_input else materialise(df, "window")
            if counts_from is not None:
                hot = hot_groups(df, keys, max_group_rows)
        if hot.any:
            # The types are those of the plain window, whatever way the rows took.
            types = {f.name: f.dataType for f in _plain_window(df, functions, keys, sorts, frame).schema}
            cut = _split_window(df, list(functions), keys, sorts, frame, hot, max_group_rows)
            return cut.withColumns({f.alias: F.col(f"`{f.alias}`").cast(types[f.alias]) for f in functions})
    return _plain_window(df, functions, keys, sorts, frame)


# ------------------------------------------------------------------ plain windows


def _plain_window(df, functions, keys, sorts, frame) -> DataFrame:
    base = W.partitionBy(*keys)
    if sorts:
        base = base.orderBy(*sort_columns(sorts))
    framed = frame.apply(base) if frame else base
    types = {f.name: f.dataType for f in df.schema}
    # Ranking and offset functions have a fixed frame of their own; Spark rejects any other.
    placed = {f: _call(f, types).over(base if f.name in RANKING | OFFSETS else framed) for f in functions}
    return df.withColumns({f.alias: c.cast("bigint") if f.name in COUNTING else c for f, c in placed.items()})


def _call(f: WindowFn, types: dict[str, DataType]) -> Column:
    name = f.name
    if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        return getattr(F, name)()
    if name == "ntile":
        return F.ntile(f.n)
    if name in OFFSETS:
        return getattr(F, name)(f.column, f.offset, _typed(f.default, types.get(f.column)))
    if name == "nth_value":
        return F.nth_value(f.column, f.offset, f.ignore_nulls)
    if name in ("first", "last"):
        return getattr(F, name)(f.column, f.ignore_nulls)
    if name == "count" and f.column in (None, "*"):
        return F.count(F.lit(1))
    if name in AGGREGATES | SPREADS:
        return getattr(F, name)(f.column)
    raise ValueError(f"unknown window function {f.function!r}")


def _typed(value, data_type: DataType | None):
    """A default given as text takes the column's type (Python value, as lag/lead want a literal)."""
    if not isinstance(value, str) or data_type is None:
        return value
    kind = data_type.typeName()
    if kind in ("integer", "long", "short", "byte"):
        return int(value)
    if kind in ("double", "float"):
        return float(value)
    if kind == "boolean":
        return value.lower() == "true"
    return value


# ------------------------------------------------------------------ cutting along the order


@dataclass(frozen=True)
class Bounds:
    """Sorted sort-key values between the chunks, held as one array literal."""

    sorts: Sequence[Sort]
    values: Column
    count: int

    def _not_before(self, keys: Sequence[Column], bound: Column) -> Column:
        """True when a row with these sort keys sorts at or after ``bound``."""
        before = F.lit(False)
        for i, (s, c) in reversed(list(enumerate(zip(self.sorts, keys)))):
            b = bound[f"k{i}"]
            smaller = F.coalesce(c > b if s.descending else c < b, F.lit(False))
            missing = (c.isNull() & b.isNotNull()) if s.nulls_first else (c.isNotNull() & b.isNull())
            before = smaller | missing | (c.eqNullSafe(b) & before)
        return ~before

    def chunk(self, keys: Sequence[Column]) -> Column:
        """1 + the number of bounds at or before the row: a binary search of log2(count) steps, so
        that thousands of bounds cost neither generated code nor comparisons."""
        if not self.count:
            return F.lit(1)
        steps = [2 ** e for e in reversed(range(self.count.bit_length()))]

        def advance(at: Column, step: Column) -> Column:
            fits = at + step <= self.count
            return at + F.when(fits & self._not_before(keys, F.get(self.values, F.least(at + step, F.lit(self.count)) - 1)), step).otherwise(0)

        return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), advance) + 1


def sampled_bounds(df: DataFrame, sorts: Sequence[Sort], rows: int, chunks: int) -> Bounds:
    """Sort-key values that cut ``df`` (of ``rows`` rows) into about ``chunks`` equal parts, from a sample of about ``chunks * SAMPLES_PER_CHUNK``.
    They travel as JSON text: rounding there would only shift a border, never break the order."""
    wanted = chunks * SAMPLES_PER_CHUNK
    fraction = min(1.0, wanted / max(rows, 1))
    names = list(dict.fromkeys(s.column for s in sorts))
    sample = df.select(*names).sample(fraction, seed=11) if fraction < 1.0 else df.select(*names)
    key = F.struct(*[F.col(s.column).alias(f"k{i}") for i, s in enumerate(sorts)])
    text = F.to_json(key, {"ignoreNullFields": "false"})
    ordered = [r["j"] for r in sample.orderBy(*sort_columns(sorts)).select(text.alias("j")).collect()]
    step = max(1, len(ordered) // chunks)
    picked = list(dict.fromkeys(ordered[step::step]))[: chunks - 1]
    types = {f.name: f.dataType for f in df.schema}
    kind = ArrayType(StructType([StructField(f"k{i}", types[s.column]) for i, s in enumerate(sorts)]))
    return Bounds(sorts, F.from_json(F.lit("[" + ",".join(picked) + "]"), kind), len(picked))


def _flag_hot(df: DataFrame, keys, hot: HotGroups) -> DataFrame:
    """Mark rows of hot groups. The listed keys are few (size checked), so they are broadcast."""
    if not keys:
        return df.withColumn("__hot", F.lit(True))
    table = hot.frame.select(*[F.col(k).alias(f"__h_{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hot"))
    if hot.count is not None:
        table = F.broadcast(table)
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"__h_{i}")) for i, k in enumerate(keys)])
    joined = df.join(table, cond, "left").drop(*[f"__h_{i}" for i in range(len(keys))])
    return joined.withColumn("__hot", F.coalesce("__hot", F.lit(False)))


def _attach(df: DataFrame, summary: DataFrame, keys, part: str, values: Sequence[str], small: bool) -> DataFrame:
    """Join per-(key, part) offsets back. Only hot groups have rows in ``summary``."""
    side = summary.select(
        *[F.col(k).alias(f"__s_{i}") for i, k in enumerate(keys)], F.col(part).alias("__s_part"), *values
    )
    cond = df[part] == F.col("__s_part")
    for i, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(F.col(f"__s_{i}"))
    return df.join(F.broadcast(side) if small else side, cond, "left").drop(
        "__s_part", *[f"__s_{i}" for i in range(len(keys))]
    )


def _split_window(df, functions, keys, sorts, frame, hot: HotGroups, max_rows: int) -> DataFrame:
    names = df.columns
    whole = frame.whole if frame else not sorts
    open_rows = frame is not None and frame.kind == "rows" and not whole and not frame.running and not frame.bounded
    open_range = frame is None or (frame.kind == "range" and not whole and not frame.bounded)
    range_fns, chunk_fns, block_fns, total_fns, pick_fns, shifted_fns, value_fns = [], [], [], [], [], [], []
    for f in functions:
        if f.name in RANKING:
            chunk_fns.append(f)
        elif f.name in OFFSETS:
            block_fns.append(f)
        elif f.name in AGGREGATES | SPREADS - {"collect_list"} and whole:
            total_fns.append(f)
        elif f.name in PICKS and whole and frame is not None:
            pick_fns.append(f)
        elif f.name in AGGREGATES and (frame is None or frame.running):
            chunk_fns.append(f)
        elif f.name in AGGREGATES and open_rows:
            shifted_fns.append(f)
        elif f.name in AGGREGATES | {"first", "last"} and open_range:
            value_fns.append(f)
        elif f.name in AGGREGATES | SPREADS and frame.kind == "range" and frame.bounded and len(sorts) == 1:
            range_fns.append(f)
        elif frame is not None and frame.kind == "rows" and (frame.bounded or (frame.running and f.name in ("first", "last"))):
            block_fns.append(f)
        else:
            raise ValueError(f"{f.function} over this frame is not available for groups of more than {max_rows} rows")
    if total_fns:
        df = _totals(df, total_fns, keys)
    for f in pick_fns:
        df = _whole_pick(df, f, keys, sorts)
    if range_fns:
        df = _range_pass(df, range_fns, keys, sorts, frame, hot, max_rows)
    if shifted_fns:
        df = _shifted_pass(df, shifted_fns, keys, sorts, frame, hot, max_rows)
    if value_fns:
        df = _value_pass(df, value_fns, keys, sorts, frame or RUNNING_RANGE, max_rows)
    if chunk_fns or block_fns:
        # Chunks keep equal sort keys together. Where those alone are too many, peers go by value, and
        # functions that number rows get the order that Spark leaves open from a hash of the row.
        if hot_groups(df, list(dict.fromkeys([*keys, *(s.column for s in sorts)])), max_rows).any:
            by_value = [f for f in chunk_fns if f.name in ("rank", "dense_rank", "percent_rank", "cume_dist") or (f.name in AGGREGATES and (frame is None or frame.kind == "range"))]
            if by_value:
                df = _value_pass(df, by_value, keys, sorts, RUNNING_RANGE, max_rows)
                chunk_fns = [f for f in chunk_fns if f not in by_value]
            df = df.withColumns({"__tie": row_hash(df), "__tie_no": F.monotonically_increasing_id()})
            sorts = [*sorts, Sort("__tie"), Sort("__tie_no")]
    if chunk_fns or block_fns:
        extra = [WindowFn("row_number", "__rn")] if block_fns else []
        df = _chunk_pass(df, chunk_fns + extra, keys, sorts, frame or RUNNING_RANGE, hot, max_rows)
    if block_fns:
        df = _block_pass(df, block_fns, keys, frame, max_rows)
    return df.select(*names, *[f.alias for f in functions])


def _value_pass(df, functions, keys, sorts, frame, max_rows) -> DataFrame:
    """Functions of the sort value: one row per (key, sort key), the window over those, joined back NULL-safely.

    A frame that ends k after the current value reads the running value of the nearest sort key up to
    there: bounds are put among the sort keys as rows of their own, and the last value before each is
    carried to it. Frames open at the far end run in reverse order.
    """
    names = df.columns
    places = list(dict.fromkeys(s.column for s in sorts))
    shift, order, swapped = frame.end, sorts, {}
    if frame.end == UNBOUNDED:
        shift, order, swapped = -frame.start, [s.reversed() for s in sorts], {"first": "last", "last": "first"}
    if shift and len(sorts) != 1:
        raise ValueError("a RANGE frame with an offset takes one sort key")
    aggs, runs = [F.count(F.lit(1)).alias("__n")], [WindowFn("sum", "__n_run", "__n"), WindowFn("row_number", "__nr")]
    for i, f in enumerate(functions):
        if f.name in ("sum", "avg"):
            aggs.append(F.sum(f.column).alias(f"__sum_{i}"))
            runs.append(WindowFn("sum", f"__sum_run_{i}", f"__sum_{i}"))
        if f.name in ("avg", "count"):
            aggs.append(F.count(F.lit(1) if f.column in (None, "*") else F.col(f.column)).alias(f"__cnt_{i}"))
            runs.append(WindowFn("sum", f"__cnt_run_{i}", f"__cnt_{i}"))
        if f.name in ("min", "max"):
            aggs.append(getattr(F, f.name)(f.column).alias(f"__ext_{i}"))
            runs.append(WindowFn(f.name, f"__ext_run_{i}", f"__ext_{i}"))
        if f.name in ("first", "last"):
            seen = F.when(F.col(f.column).isNotNull() | F.lit(not f.ignore_nulls), F.struct(F.col(f.column).alias("v")))
            aggs.append(getattr(F, f.name)(seen, True).alias(f"__pick_{i}"))
            runs.append(WindowFn(swapped.get(f.name, f.name), f"__pick_run_{i}", f"__pick_{i}"))
    groups = materialise(df.groupBy(*dict.fromkeys([*keys, *places])).agg(*aggs), "window-values")
    cut = {"partition_by": keys, "max_group_rows": max_rows, "stable_input": True}
    found = window(groups, runs, order_by=order, frame=RUNNING_ROWS, **cut)
    if any(f.name in ("percent_rank", "cume_dist") for f in functions):
        found = _totals(found, [WindowFn("sum", "__n_all", "__n")], keys)
    if shift:
        s, types = order[0], {f.name: f.dataType for f in groups.schema}
        at = F.col(s.column) + F.lit(-shift if s.descending else shift).cast(types[s.column])
        reads = [r.alias for r in runs]
        known = found.select(*keys, F.col(s.column).alias("__at"), F.lit(0).alias("__ask"), F.col(s.column).alias("__for"), F.struct(*reads).alias("__upto"))
        asked = groups.select(*keys, at.alias("__at"), F.lit(1).alias("__ask"), F.col(s.column).alias("__for"), F.lit(None).cast(known.schema["__upto"].dataType).alias("__upto"))
        both = materialise(known.union(asked), "window-bounds")
        answered = window(both, [WindowFn("last", "__got", "__upto")], order_by=[Sort("__at", s.direction, s.nulls), "__ask", "__for"], frame=RUNNING_ROWS, **cut)
        found = answered.filter("__ask = 1").select(*keys, F.col("__for").alias(s.column), *[F.col(f"__got.{r}").alias(r) for r in reads])
    out = {}
    for i, f in enumerate(functions):
        rank = (F.col("__n_run") - F.col("__n") + 1) if not shift else None
        if f.name == "rank":
            out[f.alias] = rank
        elif f.name == "dense_rank":
            out[f.alias] = F.col("__nr")
        elif f.name == "percent_rank":
            out[f.alias] = F.when(F.col("__n_all") > 1, (rank - 1) / F.greatest(F.col("__n_all") - 1, F.lit(1))).otherwise(F.lit(0.0))
        elif f.name == "cume_dist":
            out[f.alias] = F.col("__n_run") / F.col("__n_all")
        elif f.name == "avg":
            out[f.alias] = F.try_divide(F.col(f"__sum_run_{i}"), F.col(f"__cnt_run_{i}"))
        elif f.name == "count":
            out[f.alias] = F.coalesce(F.col(f"__cnt_run_{i}"), F.lit(0))
        elif f.name in ("first", "last"):
            out[f.alias] = F.col(f"__pick_run_{i}.v")
        else:
            out[f.alias] = F.col(f"__sum_run_{i}" if f.name == "sum" else f"__ext_run_{i}")
    stats = found.select(*dict.fromkeys([*keys, *places]), *[c.alias(a) for a, c in out.items()])
    return join_back(df, stats, list(dict.fromkeys([*keys, *places]))).select(*names, *out)


def _whole_pick(df, f: WindowFn, keys, sorts) -> DataFrame:
    """First, last or n-th row of the whole partition: a top-n, pruned in each map task, joined back."""
    n = f.offset if f.name == "nth_value" else 1
    order = [s.reversed() for s in sorts] if f.name == "last" else sorts
    known = df.filter(F.col(f.column).isNotNull()) if f.ignore_nulls else df
    picked = top_n(known.select(*dict.fromkeys([*keys, f.column, *[s.column for s in sorts]])), n, partition_by=keys, order_by=order, alias="__rn").filter(F.col("__rn") == n)
    if not keys:
        return df.withColumn(f.alias, picked.select(f.column).scalar())
    side = picked.select(*[F.col(k).alias(f"__p_{i}") for i, k in enumerate(keys)], F.col(f.column).alias(f.alias))
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"__p_{i}")) for i, k in enumerate(keys)])
    return df.join(side, cond, "left").drop(*[f"__p_{i}" for i in range(len(keys))])


def _shifted_pass(df, functions, keys, sorts, frame, hot: HotGroups, max_rows) -> DataFrame:
    """ROWS frames open at one end: the running value of a row k places away, or the total of the
    partition where there is no such row. Frames open at the far end run in reverse order."""
    names = df.columns
    if frame.end == UNBOUNDED:
        sorts, shift = [s.reversed() for s in sorts], -frame.start
    else:
        shift = frame.end
    running = [WindowFn(f.function, f"__run_{i}", f.column) for i, f in enumerate(functions)]
    df = _chunk_pass(df, [*running, WindowFn("row_number", "__rn")], keys, sorts, RUNNING_ROWS, hot, max_rows)
    df = df.withColumn("__run", F.struct(*[r.alias for r in running])).drop(*[r.alias for r in running])
    moved = WindowFn("lead" if shift > 0 else "lag", "__moved", "__run", offset=abs(shift))
    df = _block_pass(df, [moved], keys, None, max_rows)
    if shift > 0:
        df = _totals(df, [WindowFn(f.function, f"__all_{i}", f.column) for i, f in enumerate(functions)], keys)
    out = {}
    for i, f in enumerate(functions):
        outside = F.col(f"__all_{i}") if shift > 0 else F.lit(0 if f.name == "count" else None)
        out[f.alias] = F.when(F.col("__moved").isNull(), outside).otherwise(F.col(f"__moved.__run_{i}"))
    return df.withColumns(out).select(*names, *out)


def _totals(df, functions, keys) -> DataFrame:
    """Whole-partition aggregates need no order: aggregate with map-side combine, then join."""
    types = {f.name: f.dataType for f in df.schema}
    aggs = [_call(f, types).alias(f.alias) for f in functions]
    if not keys:
        single = df.agg(F.struct(*aggs).alias("t")).scalar()     # scalar subquery: one row, no join
        return df.withColumn("__t", single).select("*", *[F.col(f"__t.{f.alias}") for f in functions]).drop("__t")
    totals = df.groupBy(*keys).agg(*aggs)
    side = totals.select(*[F.col(k).alias(f"__t_{i}") for i, k in enumerate(keys)], *[f.alias for f in functions])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"__t_{i}")) for i, k in enumerate(keys)])
    return df.join(side, cond, "left").drop(*[f"__t_{i}" for i in range(len(keys))])


def _chunk_pass(df, functions, keys, sorts, frame, hot: HotGroups, max_rows) -> DataFrame:
    names = df.columns
    flagged = _flag_hot(df, keys, hot)
    chunks = max(2, min(MAX_CHUNKS, -(-2 * hot.rows // max_rows)))
    hot_only = flagged.filter("__hot") if keys else df
    bounds = sampled_bounds(hot_only, sorts, hot.rows, chunks)
    chunked = flagged.withColumn("__chunk", F.when(F.col("__hot"), bounds.chunk([F.col(s.column) for s in sorts])).otherwise(F.lit(0)))

    needs_total = any(f.name in ("percent_rank", "cume_dist", "ntile") for f in functions)
    running = [f for f in functions if f.name in AGGREGATES]
    aggs = [F.count(F.lit(1)).alias("__n")]
    if any(f.name == "dense_rank" for f in functions):
        aggs.append(F.count_distinct(F.struct(*[s.column for s in sorts])).alias("__d"))
    for i, f in enumerate(running):
        if f.name in ("sum", "avg"):
            aggs.append(F.sum(f.column).alias(f"__sum_{i}"))
        if f.name in ("avg", "count"):
            aggs.append(F.count(F.lit(1) if f.column in (None, "*") else F.col(f.column)).alias(f"__cnt_{i}"))
        if f.name in ("min", "max"):
            aggs.append(getattr(F, f.name)(f.column).alias(f"__ext_{i}"))
    summary = chunked.filter("__hot").groupBy(*keys, "__chunk").agg(*aggs)
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    values = {"__n_off": F.sum("__n").over(earlier), "__n_all": F.sum("__n").over(every)}
    if "__d" in summary.columns:
        values["__d_off"] = F.sum("__d").over(earlier)
    for c in summary.columns:
        if c.startswith(("__sum_", "__cnt_")):
            values[c + "_off"] = F.sum(c).over(earlier)
        if c.startswith("__ext_"):
            f = running[int(c.rsplit("_", 1)[1])]
            values[c + "_off"] = getattr(F, f.name)(c).over(earlier)
    offsets = summary.withColumns(values)
    # One row per hot key and chunk: small by construction when the hot keys are few.
    few = hot.count is not None and hot.count * chunks <= MAX_SUMMARY_ROWS
    joined = _attach(chunked, offsets, keys, "__chunk", list(values), small=few)

    inside = W.partitionBy(*keys, "__chunk")
    ordered = inside.orderBy(*sort_columns(sorts))
    local = frame.apply(ordered) if frame.running else RUNNING_RANGE.apply(ordered)
    zero = F.lit(0)
    before = F.coalesce("__n_off", zero)
    total = F.coalesce(F.col("__n_all"), F.count(F.lit(1)).over(inside)) if needs_total else None
    out: dict[str, Column] = {}
    for f in functions:
        if f.name == "row_number":
            out[f.alias] = (F.row_number().over(ordered) + before).cast("long")
        elif f.name == "rank":
            out[f.alias] = (F.rank().over(ordered) + before).cast("long")
        elif f.name == "dense_rank":
            out[f.alias] = (F.dense_rank().over(ordered) + F.coalesce("__d_off", zero)).cast("long")
        elif f.name == "percent_rank":
            rank = F.rank().over(ordered) + before
            out[f.alias] = F.when(total > 1, (rank - 1) / F.greatest(total - 1, F.lit(1))).otherwise(F.lit(0.0))
        elif f.name == "cume_dist":
            peers = F.count(F.lit(1)).over(RUNNING_RANGE.apply(ordered)) + before
            out[f.alias] = peers / total
        elif f.name == "ntile":
            rn = F.row_number().over(ordered) + before
            out[f.alias] = _ntile(rn, total, f.n)
    for i, f in enumerate(running):
        if f.name == "count":
            counted = F.count(F.lit(1)) if f.column in (None, "*") else F.count(f.column)
            out[f.alias] = counted.over(local) + F.coalesce(f"__cnt_{i}_off", zero)
        elif f.name == "sum":
            out[f.alias] = _add(F.sum(f.column).over(local), F.col(f"__sum_{i}_off"))
        elif f.name == "avg":
            s = _add(F.sum(f.column).over(local), F.col(f"__sum_{i}_off"))
            n = F.count(f.column).over(local) + F.coalesce(f"__cnt_{i}_off", zero)
            out[f.alias] = F.try_divide(s, n)
        else:
            pick = F.least if f.name == "min" else F.greatest
            out[f.alias] = pick(getattr(F, f.name)(f.column).over(local), F.col(f"__ext_{i}_off"))
    return joined.withColumns(out).select(*names, *[f.alias for f in functions])


def _add(a: Column, b: Column) -> Column:
    """a + b where a missing side counts as nothing, and both missing stay NULL."""
    return F.coalesce(a + b, a, b)


def _ntile(rn: Column, total: Column, n: int) -> Column:
    size, rest = F.floor(total / n), total % n
    wide = rest * (size + 1)
    return F.when(rn <= wide, F.floor((rn - 1) / (size + 1)) + 1).otherwise(
        rest + F.floor((rn - 1 - wide) / F.greatest(size, F.lit(1))) + 1
    ).cast("int")


def block_spread(df: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Every row in its block of ``size`` row numbers (``__own``), and copies of the ``before`` and ``after`` rows at a border in the block beyond it."""
    place, pos = F.floor((F.col("__rn") - 1) / size), (F.col("__rn") - 1) % size
    copies = F.array(
        F.struct(place.alias("block"), F.lit(True).alias("own")),
        F.when(pos >= size - before, F.struct((place + 1).alias("block"), F.lit(False).alias("own"))),
        F.when((pos < after) & (place > 0), F.struct((place - 1).alias("block"), F.lit(False).alias("own"))),
    )
    spread = df.withColumn("__c", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    return spread.withColumns({"__block": F.col("__c.block"), "__own": F.col("__c.own")}).drop("__c")


def _block_pass(df, functions, keys, frame, max_rows) -> DataFrame:
    """Blocks of consecutive row numbers plus a halo of copied border rows."""
    names = [c for c in df.columns if c != "__rn"]
    types = {f.name: f.dataType for f in df.schema}
    sliding = frame is not None and frame.bounded
    before = max([f.offset for f in functions if f.name == "lag"] + ([max(0, -frame.start, -frame.end)] if sliding else []) + [0])
    after = max([f.offset for f in functions if f.name == "lead"] + ([max(0, frame.end, frame.start)] if sliding else []) + [0])
    size = max(max_rows, before, after, 1)
    place = F.floor((F.col("__rn") - 1) / size)
    spread = block_spread(df, before, after, size)
    ordered = W.partitionBy(*keys, "__block").orderBy("__rn")
    out = {}
    for f in functions:
        if f.name in OFFSETS:
            out[f.alias] = _call(f, types).over(ordered)
        elif sliding:
            out[f.alias] = _call(f, types).over(frame.apply(ordered))
    running = [f for f in functions if f.alias not in out]
    if running:
        # first/last so far: the nearest value inside the block, else the carry from earlier blocks.
        aggs = []
        for i, f in enumerate(running):
            counted = F.when(F.col(f.column).isNotNull() | F.lit(not f.ignore_nulls), F.col("__rn"))
            by = F.max_by if f.name == "last" else F.min_by
            aggs.append(by(F.struct(F.col(f.column).alias("v")), counted).alias(f"__pick_{i}"))
        summary = df.withColumn("__block", place).groupBy(*keys, "__block").agg(*aggs)
        prior = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        carry = {f"__carry_{i}": getattr(F, f.name)(f"__pick_{i}", True).over(prior) for i, f in enumerate(running)}
        carried = summary.withColumns(carry).filter("__block > 0")
        spread = _attach(spread, carried, keys, "__block", list(carry), small=False)
        so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
        for i, f in enumerate(running):
            seen = F.when(F.col(f.column).isNotNull() | F.lit(not f.ignore_nulls), F.struct(F.col(f.column).alias("v")))
            local, before_block = getattr(F, f.name)(seen, True).over(so_far), F.col(f"__carry_{i}")
            picked = F.coalesce(before_block, local) if f.name == "first" else F.coalesce(local, before_block)
            out[f.alias] = picked["v"]
    return spread.withColumns(out).filter("__own").select(*names, *[f.alias for f in functions])


def range_spread(df, keys, s: Sort, frame: Frame, hot: HotGroups, max_rows: int) -> DataFrame:
    """Every row in its chunk (``__own``), and a copy in every other chunk (``__chunk``) whose rows see it in their RANGE frame."""
    types, sign = {f.name: f.dataType for f in df.schema}, -1 if s.descending else 1
    flagged = _flag_hot(df, keys, hot)
    chunks = max(2, min(MAX_CHUNKS, -(-2 * hot.rows // max_rows)))
    bounds = sampled_bounds(flagged.filter("__hot") if keys else df, [s], hot.rows, chunks)

    def chunk_at(shift):
        value = F.col(s.column) + F.lit(shift).cast(types[s.column]) if shift else F.col(s.column)
        return F.when(F.col("__hot"), bounds.chunk([value])).otherwise(F.lit(0))

    work = flagged.withColumns({"__own": chunk_at(0), "__from": chunk_at(-sign * frame.end), "__to": chunk_at(-sign * frame.start)})
    reach = F.sequence(F.least("__from", "__to", "__own"), F.greatest("__from", "__to", "__own"))
    return work.withColumn("__chunk", F.explode(reach)).drop("__from", "__to", "__hot")


def _range_pass(df, functions, keys, sorts, frame, hot: HotGroups, max_rows) -> DataFrame:
    """Sliding RANGE frame over one numeric sort key: a row is copied to every chunk whose rows see it."""
    names, types = df.columns, {f.name: f.dataType for f in df.schema}
    spread = range_spread(df, keys, sorts[0], frame, hot, max_rows)
    framed = frame.apply(W.partitionBy(*keys, "__chunk").orderBy(*sort_columns(sorts)))
    out = {f.alias: _call(f, types).over(framed) for f in functions}
    return spread.withColumns(out).filter("__chunk = __own").select(*names, *[f.alias for f in functions])


# ------------------------------------------------------------------ common uses


def running_total(df, column, alias, *, partition_by=(), order_by, **kw) -> DataFrame:
    return window(df, [WindowFn("sum", alias, column)], partition_by=partition_by, order_by=order_by, frame=RUNNING_ROWS, **kw)


def moving(df, functions, rows: int, *, partition_by=(), order_by, **kw) -> DataFrame:
    """Aggregates over the current row and the ``rows - 1`` before it."""
    return window(df, functions, partition_by=partition_by, order_by=order_by, frame=Frame("rows", -(rows - 1), 0), **kw)


def top_n(df: DataFrame, n: int, *, partition_by: Sequence[str], order_by, alias: str = "rn", ties: bool = False) -> DataFrame:
    """First ``n`` rows per group. Spark prunes each map task to its own n best rows before the
    shuffle (window group limit), so a dominant group never travels whole."""
    spec = W.partitionBy(*partition_by).orderBy(*sort_columns(order_by))
    ranked = df.withColumn(alias, (F.rank() if ties else F.row_number()).over(spec))
    return ranked.filter(F.col(alias) <= n)


def sessionize(df: DataFrame, *, user: Sequence[str], ts: str, gap_seconds: int, tie_breaker: Sequence[str] = (),
               alias: str = "session_no", **kw) -> DataFrame:
    """Number the sessions of each user; a gap longer than ``gap_seconds`` opens a new one."""
    order = [ts, *tie_breaker]
    seen = window(df, [WindowFn("lag", "__prev", ts)], partition_by=user, order_by=order, **kw)
    gap = F.timestamp_diff("SECOND", F.col("__prev"), F.col(ts))
    flagged = seen.withColumn("__new", F.when(F.col("__prev").isNull() | (gap > gap_seconds), 1).otherwise(0))
    # The second pass runs on a derived input: size it by the stored table, and fix it when hot.
    again = {"counts_from": df, **kw, "stable_input": False}
    return window(flagged, [WindowFn("sum", alias, "__new")], partition_by=user, order_by=order, frame=RUNNING_ROWS, **again).drop("__prev", "__new")


def session_summary(df: DataFrame, *, user: Sequence[str], ts: str, gap_seconds: int, tie_breaker=(), **kw) -> DataFrame:
    """One row per session: number, start, end, duration and event count."""
    s = sessionize(df, user=user, ts=ts, gap_seconds=gap_seconds, tie_breaker=tie_breaker, **kw)
    return s.groupBy(*user, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"),
        F.timestamp_diff("SECOND", F.min(ts), F.max(ts)).alias("duration_s"),
    )
