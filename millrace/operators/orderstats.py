"""Percentiles and medians over moving frames, without a frame per row.

Rows are dealt to groups that a task can hold: blocks of row numbers with the border rows copied
(ROWS), or chunks of the sort value with the rows that reach into them (RANGE). Inside a task the
values of many groups form one wavelet matrix: their ranks, bit by bit from the highest, with the
running count of zeros on each level. The k-th value of any stretch of rows is found by walking down
the levels, where two counts tell on which side it lies; many rows walk at once. That takes
n log n steps whatever the width of the frames, and no row carries its frame. A task answers rows
as soon as their frames have come in and lets go of rows that no later frame sees, so it holds
``HELD_ROWS`` rows or twice a frame, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FractionalType, StructField, StructType

from millrace.operators import windows
from millrace.operators.ordering import as_sorts
from millrace.operators.sizing import MAX_GROUP_ROWS, hot_groups
from millrace.operators.windows import UNBOUNDED, Frame, WindowFn
from millrace.session import materialise

HELD_ROWS = 1 << 18       # rows are worked off when so many have come together
WALKED_ROWS = 1 << 16     # rows that walk down the levels at once


class RankTree:
    """Wavelet matrix over the ranks of ``values``; ``kth`` answers for many stretches at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.sorted, rank = np.unique(values, return_inverse=True)
        kind = np.int32 if len(rank) < 1 << 31 else np.int64
        rank, self.levels = rank.astype(kind), []
        for bit in reversed(range(max(1, int(max(len(self.sorted) - 1, 0)).bit_length()))):
            ones = (rank >> bit) & 1
            zeros = np.zeros(len(rank) + 1, kind)
            np.cumsum(1 - ones, dtype=kind, out=zeros[1:])
            self.levels.append((bit, zeros))
            rank = np.concatenate((rank[ones == 0], rank[ones == 1]))

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[lo:hi], for 0 <= k < hi - lo."""
        lo, hi, k, rank = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo], zeros[hi]
            right = k >= b - a
            k -= np.where(right, b - a, 0)
            lo, hi = np.where(right, zeros[-1] + lo - a, a), np.where(right, zeros[-1] + hi - b, b)
            rank += right.astype(np.int64) << bit
        return self.sorted[rank]


def quantiles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, fractions: Sequence[tuple[float, bool]]) -> list[np.ma.MaskedArray]:
    """For each (p, continuous) the percentile of every values[lo:hi]; NaN values count as missing, a stretch without values is masked."""
    known = ~np.isnan(values)
    before = np.concatenate(([0], np.cumsum(known)))
    lo, hi = before[lo], before[np.maximum(lo, hi)]
    some = hi > lo
    out = [np.ma.MaskedArray(np.zeros(len(lo)), ~some) for _ in fractions]
    tree, every = RankTree(values[known]), np.flatnonzero(some)
    for rows in np.split(every, range(WALKED_ROWS, len(every), WALKED_ROWS)):
        a, b, n = lo[rows], hi[rows], (hi - lo)[rows]
        for whole, (p, continuous) in zip(out, fractions):
            if continuous:
                at = p * (n - 1)
                low, high = tree.kth(a, b, np.floor(at).astype(np.int64)), tree.kth(a, b, np.ceil(at).astype(np.int64))
                whole.data[rows] = low + (high - low) * (at - np.floor(at))
            else:
                whole.data[rows] = tree.kth(a, b, np.maximum(np.ceil(p * n).astype(np.int64), 1) - 1)
    return out


def _bounds_of_rows(group: np.ndarray, start: int | None, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 position of every row's frame; rows are in order, ``group`` numbers rise by one."""
    sizes = np.bincount(group)
    ends = np.cumsum(sizes)[group]
    first, at = ends - sizes[group], np.arange(len(group))
    lo = first if start is None else np.clip(at + start, first, ends)
    return lo, np.clip(at + end + 1, first, ends) if end is not None else ends


def _bounds_of_values(group: np.ndarray, missing: np.ndarray, place: np.ndarray, start, end) -> tuple[np.ndarray, np.ndarray]:
    """The same by sort value, ascending within a group. Rows without one are peers of each other and come last."""
    part = group * 2 + missing
    place = np.where(missing, 0, place)
    low = place if start is None else np.where(missing, 0, place + start)
    high = place if end is None else np.where(missing, 0, place + end)
    every = np.unique(np.concatenate((place, low, high)))
    code = lambda v: part * np.int64(len(every)) + np.searchsorted(every, v)
    own = code(place)
    lo = np.searchsorted(own, code(low), "left") if start is not None else np.searchsorted(group, group, "left")
    hi = np.searchsorted(own, code(high), "right") if end is not None else np.searchsorted(group, group, "right")
    return lo, hi


def _answered(fractions: Sequence[tuple[float, bool]], kept: Sequence[str], start, end, by_value: bool, names: Sequence[str]):
    def frames(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The running number of every row's group, and the bounds of its frame among ``rows``."""
        new = np.asarray(rows["__group"])
        group = np.cumsum(np.concatenate(([False], new[1:] != new[:-1])))
        if not by_value:
            return group, *_bounds_of_rows(group, start, end)
        missing = np.asarray(rows["__place"].is_null())
        fill = pa.scalar(0, rows["__place"].type)
        return group, *_bounds_of_values(group, missing, np.asarray(rows["__place"].fill_null(fill)), start, end)

    def answers(rows: pa.Table, lo: np.ndarray, hi: np.ndarray, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """The own rows among rows[first:last] with their percentiles."""
        own = np.asarray(rows["__mine"])[first:last]
        at = first + np.flatnonzero(own)
        if not len(at):
            return
        lo, hi = lo[at], np.maximum(lo, hi)[at]
        low, high = int(lo.min()), int(hi.max())
        values = np.asarray(rows["__value"].slice(low, high - low).fill_null(float("nan")), float)
        out = rows.select(kept).slice(first, last - first).filter(pa.array(own))
        for name, column in zip(names, quantiles(values, lo - low, hi - low, fractions)):
            out = out.append_column(name, pa.array(column.data, pa.float64(), mask=np.ma.getmaskarray(column)))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = done = 0                # rows held; the first ``done`` are answered and seen by later frames
        limit = HELD_ROWS
        for batch in chain(batches, [None]):
            if batch is not None:
                held += [batch] if batch.num_rows else []
                count += batch.num_rows
            if not count or (batch is not None and count < limit):
                continue
            rows = pa.Table.from_batches(held)
            group, lo, hi = frames(rows)
            # Only the last group may go on: its frames are whole where they end before the last row held.
            opened = int(np.searchsorted(group, group[-1]))
            ready = count if batch is None else opened + int(np.searchsorted(hi[opened:], count))
            yield from answers(rows, lo, hi, done, ready)
            # Frames begin ever later, so no row to come sees more than the last one here or one not answered.
            seen = min(ready, int(lo[max(opened, min(ready, count - 1)):].min()))
            held = rows.slice(seen).to_batches()
            count, done = count - seen, ready - seen
            limit = max(HELD_ROWS, 2 * count)       # rows are gone through a fixed number of times
            del rows, group, lo, hi
    return run


def moving_quantiles(df: DataFrame, fractions: Mapping[str, float | tuple[float, str]], column: str, *, partition_by: Sequence[str] = (), order_by,
                     frame: Frame, max_group_rows: int = MAX_GROUP_ROWS, stable_input: bool = False) -> DataFrame:
    """Append percentiles of ``column`` over a moving frame: ``fractions`` maps a new column to p or to (p, "disc").

    Continuous percentiles interpolate between the two nearest values, discrete ones are a value of the frame. Missing
    values are left out, a frame without values gives NULL; results are doubles. ROWS frames may be bounded or open at
    one end, RANGE frames the same over one numeric or date sort key. A frame open at one end takes its whole group
    into one task and is refused for groups of more than ``max_group_rows`` rows.
    """
    names, keys, sorts = df.columns, list(partition_by), as_sorts(order_by)
    asked = [(float(p[0]), str(p[1]).lower() != "disc") if isinstance(p, tuple) else (float(p), True) for p in fractions.values()]
    if any(not 0 <= p <= 1 for p, _ in asked):
        raise ValueError("percentiles lie between 0 and 1")
    start, end = (None if e == UNBOUNDED else e for e in (frame.start, frame.end))
    by_value = frame.kind == "range"
    if by_value and len(sorts) != 1:
        raise ValueError("a RANGE frame takes one sort key")
    hot = hot_groups(df, keys, max_group_rows, screen=stable_input)
    if hot.any and (start is None or end is None):
        raise ValueError(f"percentiles over a frame open at one end take groups of up to {max_group_rows} rows")
    if hot.any and not stable_input:
        df = materialise(df, "orderstats")
    if by_value:
        s = sorts[0]
        kind = df.schema[s.column].dataType
        place = F.unix_date(s.column) if isinstance(kind, DateType) else F.col(s.column)
        place = place.cast("double" if isinstance(kind, FractionalType) else "bigint")
        if s.descending:
            start, end = (None if end is None else -end), (None if start is None else -start)
        spread = windows.range_spread(df, keys, s, frame, hot, max_group_rows) if hot.any else df.withColumns({"__chunk": F.lit(0), "__own": F.lit(0)})
        spread = spread.withColumns({"__part": F.col("__chunk").cast("bigint"), "__mine": F.col("__chunk") == F.col("__own"), "__place": place})
        within = [F.col("__place").asc_nulls_last()]
    else:
        numbered = windows.window(df, [WindowFn("row_number", "__rn")], partition_by=keys, order_by=sorts, max_group_rows=max_group_rows, stable_input=stable_input)
        before, after = (0 if start is None else max(0, -start, -(end or 0))), (0 if end is None else max(0, end, start or 0))
        spread = windows.block_spread(numbered, before, after, max(max_group_rows, before, after, 1))
        spread = spread.withColumns({"__part": F.col("__block").cast("bigint"), "__mine": F.col("__own"), "__place": F.col("__rn")})
        within = [F.col("__rn").asc()]
    # A group's number; the keys themselves keep apart what should share one.
    group = F.xxhash64(*[F.col(f"`{k}`") for k in keys], "__part")
    work = spread.withColumns({"__group": group, "__value": F.col(f"`{column}`").cast("double")})
    work = work.repartition("__group").sortWithinPartitions("__group", *[F.col(f"`{k}`") for k in keys], "__part", *within)
    work = work.select(*[f"`{c}`" for c in names], "__group", "__mine", "__place", "__value")
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in fractions]])
    return work.mapInArrow(_answered(asked, names, start, end, by_value, list(fractions)), schema)


def moving_median(df: DataFrame, column: str, alias: str, *, partition_by: Sequence[str] = (), order_by, frame: Frame, **options) -> DataFrame:
    """The continuous median over a moving frame."""
    return moving_quantiles(df, {alias: 0.5}, column, partition_by=partition_by, order_by=order_by, frame=frame, **options)
