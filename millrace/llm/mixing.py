"""Mixing sources to target weights: thresholds on a hash, found from histograms.

Every document has a place between 0 and 2**60 from the MD5 of its id and text, the same in every
run. A source's words are summed by place buckets; the running sums say in which bucket the budget
ends. Only that boundary bucket is cut again, into buckets ``LEVEL_BITS`` finer, until it holds one
row. Documents below the threshold are taken (once more), those above are not: a filter, no sort,
and a smaller budget takes a subset of what a larger one takes.

A histogram has at most 2**LEVEL_BITS rows per source, so a source with a third of all rows costs a
few thousand partial sums per task. The first histogram reads every row's (source, place, size),
each later one only the boundary buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.operators import sizing, windows
from millrace.session import materialise

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"
PLACE_BITS = 60
LEVEL_BITS = 12


def place_of(id: Column, text: Column) -> Column:
    """The leading 60 bits of an MD5 over the id and the text."""
    digest = F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes(source, source_size)`` with ``weight`` and ``target``, for any number of sources.

    Sources take the weights in the order of their names, null last. Targets are
    ``least(max_repeats * source_size, level * weight)``; the level at which they add up to the budget is the largest of
    the levels that arise when the k sources with the least room for their weight stop at their limit (k = 0, 1, ...).
    """
    numbered = windows.window(sizes, [windows.WindowFn("row_number", "nr")], order_by=[("source", "asc", "last")])
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = materialise(numbered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("most")), "mix-sources")
    ordered = weighed.withColumn("room", F.col("most").cast("double") / F.col("weight"))
    running = windows.window(ordered, [windows.WindowFn("sum", "most_so_far", "most"), windows.WindowFn("sum", "weight_so_far", "weight")],
                             order_by=["room", ("source", "asc", "last")], frame=windows.RUNNING_ROWS)
    words, weights_left = weighed.agg(F.sum("source_size")).scalar(), weighed.agg(F.sum("weight")).scalar() - F.col("weight_so_far") + F.col("weight")
    left = words.cast("double") * budget - (F.col("most_so_far") - F.col("most")).cast("double")
    level = running.select((left / weights_left.cast("double")).alias("level")).agg(F.max("level")).scalar()
    return weighed.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def _bucket(bits: int) -> Column:
    """The leading ``bits`` of a row's place, continued by its tie number."""
    if bits <= PLACE_BITS:
        return F.shiftright("place", PLACE_BITS - bits)
    return F.shiftright("tie", 2 * PLACE_BITS - bits)


def _with_source(rows: DataFrame, stored: DataFrame, how: str = "left") -> DataFrame:
    """Join a stored table with one row per source; a null source is a source. It is broadcast if it is measured to be small."""
    side = sizing.broadcast_if_small(stored.withColumnRenamed("source", "__source"))
    return rows.join(side, rows["source"].eqNullSafe(side["__source"]), how).drop("__source")


def _boundaries(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """For each of ``goals(source, rest)``: place and tie of the row in which the running sum of ``rows(source, size, place, tie)``
    passes ``rest``, the words before it and its size. Sources without words have no such row."""
    state, bits = goals.select("source", "rest", F.lit(0).cast("bigint").alias("before")), 0
    while True:
        bits += LEVEL_BITS
        histogram = rows.groupBy("source", _bucket(bits).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"),
                                                                              F.min("place").alias("place"), F.min("tie").alias("tie"))
        earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        at = _with_source(histogram, state, "inner").withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        found = materialise(at.filter("before <= rest AND rest < before + words"), "mix-boundaries")
        if bits >= 2 * PLACE_BITS or not found.filter("rows > 1").limit(1).count():
            return found.select("source", "rest", "before", "words", "place", "tie")
        state = found.select("source", "rest", "before")
        inside = found.select("source", F.col("bucket").alias("bucket_of_source"))
        rows = materialise(_with_source(rows, inside, "inner").filter(_bucket(bits) == F.col("bucket_of_source")).drop("bucket_of_source"), "mix-inside")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = WEIGHTS,
        budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(id, source, size, source_size, target, copies)`` for every row: how often the mix takes the document.

    The whole budget is ``budget`` times all words. Each source's taken words differ from its target by at most half of the
    document at its threshold. Null and empty texts have size 0 and are never short of anything (copies follow their place);
    a null source is a source of its own, after all others; rows with a null id are documents like any other. Repeated
    rows (one id, one text) are told apart by a number, so that a threshold may fall between them; which of them is taken
    makes no difference to the result. Empty tables give empty ones; other columns are not read.
    """
    docs = picked(df, id=id_col, text=text_col, source=source_col)
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS)
    rows = materialise(docs.select(F.col("id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"),
                                   F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                                   place_of(F.col("id"), F.col("text")).alias("place"), tie.alias("tie")), "mix-rows")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    goals = materialise(targets(sizes, weights, budget, max_repeats).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    ).withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")), "mix-targets")
    ends = _boundaries(rows.select("source", "size", "place", "tie"), goals)
    # The document at the threshold is taken if that comes nearer to the target than leaving it.
    ends = ends.select("source", F.col("place").alias("end_place"), F.col("tie").alias("end_tie"), (F.col("before") * 2 + F.col("words") <= F.col("rest") * 2).alias("end_taken"))
    limits = materialise(_with_source(goals, ends).select("source", "source_size", "target", "whole", "end_place", "end_tie", "end_taken"), "mix-limits")
    below = (F.col("place") < F.col("end_place")) | ((F.col("place") == F.col("end_place")) & (F.col("tie") < F.col("end_tie")))
    at = (F.col("place") == F.col("end_place")) & (F.col("tie") == F.col("end_tie")) & F.col("end_taken")
    return _with_source(rows, limits).select("id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce((below | at).cast("bigint"), F.lit(0))).alias("copies"))


def digest(mixed: DataFrame) -> DataFrame:
    """The query's form of ``mix``."""
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
