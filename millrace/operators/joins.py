"""Joins: equi, mixed keys, lookup, range, N-way, zip and approximate text matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sizing import MAX_GROUP_ROWS, broadcast_if_small, hot_groups, row_hash
from millrace.operators.windows import WindowFn, window

# Accepted spellings of join types.
JOIN_TYPES = {
    "inner": "inner", "join": "inner",
    "left": "left", "leftouter": "left", "right": "right", "rightouter": "right",
    "full": "full", "fullouter": "full", "outer": "full",
    "cross": "cross",
    "semi": "left_semi", "leftsemi": "left_semi",
    "anti": "left_anti", "leftanti": "left_anti",
}


def join_type(text: str) -> str:
    key = text.lower().replace(" ", "").replace("_", "")
    if key not in JOIN_TYPES:
        raise ValueError(f"unknown join type {text!r}")
    return JOIN_TYPES[key]


def join(left: DataFrame, right: DataFrame, on: Sequence, how: str = "inner", *, broadcast: str | None = None,
         salt: int = 0, hot_rows: int = MAX_GROUP_ROWS, conflict: str = "error", prefix: str = "right_",
         renames: Mapping[str, str] | None = None, condition: str | None = None) -> DataFrame:
    """Equi-join. Each key is a shared name or a ``(left name, right name)`` pair; all must match.

    A shared key appears once (coalesced for right and full joins), the right column of a pair is
    dropped. ``broadcast`` = left | right asks for a broadcast, granted after measuring that side.
    ``salt`` > 1 spreads left keys with more than ``hot_rows`` rows over that many tasks. ``conflict`` decides about other
    columns present on both sides: error | prefix | prefix_left (``prefix`` goes to the left column) | drop_right |
    rename (``renames`` gives right columns their new names). ``condition`` must hold beside the keys; it uses the names
    of the result, so a row without a partner under it is unmatched in outer joins.
    """
    how = join_type(how)
    if how == "cross":
        return left.crossJoin(broadcast_if_small(right))
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    if not pairs:
        raise ValueError("a join needs at least one key; use how='cross' for a product")
    if conflict == "prefix_left" and how not in ("left_semi", "left_anti"):
        shared = set(left.columns) & set(right.columns) - {k for p in pairs for k in p}
        left = left.withColumnsRenamed({c: prefix + c for c in shared})
    right = _resolve_conflicts(left, right, pairs, how, conflict, prefix, renames or {})
    if broadcast == "right":
        right = broadcast_if_small(right)
    elif broadcast == "left":
        left = broadcast_if_small(left)
    renamed = {r: f"__r_{i}" for i, (_, r) in enumerate(pairs)}
    keyed = right.withColumnsRenamed(renamed)
    cond = reduce(lambda a, b: a & b, [left[l] == keyed[renamed[r]] for l, r in pairs])
    if salt > 1 and how in ("inner", "left", "left_semi", "left_anti"):
        left, keyed, extra = _salt(left, keyed, [l for l, _ in pairs], [renamed[r] for _, r in pairs], salt, hot_rows)
        cond = reduce(lambda a, b: a & b, [left[l] == keyed[renamed[r]] for l, r in pairs]) & extra(left, keyed)
    joined = left.join(keyed, cond if condition is None else cond & F.expr(condition), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__salt")
    if how in ("right", "full"):
        for l, r in pairs:
            if l == r:
                joined = joined.withColumn(l, F.coalesce(l, renamed[r]))
            else:
                joined = joined.withColumnRenamed(renamed[r], r)
    return joined.drop(*renamed.values(), "__salt", "__salt_r")


def _resolve_conflicts(left, right, pairs, how, conflict, prefix, renames):
    if how in ("left_semi", "left_anti"):
        return right
    if conflict == "rename":
        right = right.withColumnsRenamed({c: n for c, n in renames.items() if c not in {r for _, r in pairs}})
    shared = [c for c in right.columns if c in set(left.columns) and c not in {r for _, r in pairs}]
    if not shared:
        return right
    if conflict == "prefix":
        return right.withColumnsRenamed({c: prefix + c for c in shared})
    if conflict == "drop_right":
        return right.drop(*shared)
    raise ValueError(f"columns on both sides: {shared}; choose conflict='prefix', 'prefix_left', 'rename' or 'drop_right'")


def _salt(left, right, left_keys, right_keys, salts, hot_rows):
    """Spread rows of hot left keys by a row hash and repeat only the matching right rows."""
    hot = hot_groups(left.select(*left_keys).dropna(), left_keys, hot_rows, sketch=True)      # NULL keys meet nothing
    if not hot.any:
        return left.withColumn("__salt", F.lit(0)), right.withColumn("__salt_r", F.lit(0)), lambda l, r: l["__salt"] == r["__salt_r"]
    names = [f"__k_{i}" for i in range(len(left_keys))]
    table = hot.frame.toDF(*names).withColumn("__is_hot", F.lit(True))
    table = F.broadcast(table) if hot.count is not None else table

    def flag(df, keys):
        cond = reduce(lambda a, b: a & b, [df[k] == F.col(n) for k, n in zip(keys, names)])
        return df.join(table, cond, "left").drop(*names)

    salted = flag(left.withColumn("__row", row_hash(left)), left_keys).withColumn(
        "__salt", F.when(F.col("__is_hot"), F.pmod("__row", F.lit(salts))).otherwise(0).cast("int")
    ).drop("__is_hot", "__row")
    spread = flag(right, right_keys).withColumn(
        "__salt_r",
        F.explode(F.when(F.col("__is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    ).drop("__is_hot")
    return salted, spread, lambda l, r: l["__salt"] == r["__salt_r"]


def lookup(df: DataFrame, reference: DataFrame, on: Mapping[str, str], returning: Sequence[str], *,
           defaults: Mapping[str, object] | None = None, not_found: str = "null", broadcast: str | None = None) -> DataFrame:
    """Add columns of a reference table by key.

    ``not_found`` = null | default | reject | fail. A match flag tells a missing key from a
    genuine NULL in the reference, which is kept. The reference is pruned to the needed columns;
    Spark broadcasts it by its own size statistics, or ``broadcast="check"`` measures it first.
    """
    keys = {r: f"__l_{i}" for i, r in enumerate(on.values())}
    ref = reference.select(*[F.col(r).alias(a) for r, a in keys.items()], *returning, F.lit(True).alias("__hit"))
    if broadcast == "check":
        ref = broadcast_if_small(ref)
    cond = reduce(lambda a, b: a & b, [df[l] == ref[keys[r]] for l, r in on.items()])
    joined = df.join(ref, cond, "inner" if not_found == "reject" else "left")
    if not_found == "fail":
        message = F.concat(F.lit("no reference row for key "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
        joined = joined.withColumn("__hit", F.when(F.col("__hit").isNull(), F.raise_error(message)).otherwise(F.col("__hit")))
        joined = joined.filter("__hit")
    if defaults and not_found in ("null", "default"):
        joined = joined.withColumns({c: F.when(F.col("__hit").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})
    return joined.drop("__hit", *keys.values())


def join_many(first: DataFrame, others: Sequence[tuple]) -> DataFrame:
    """Left-deep chain of ``(table, keys, how)``; Spark may still reorder inner joins."""
    return reduce(lambda acc, o: join(acc, o[0], o[1], o[2] if len(o) > 2 else "inner"), others, first)


def self_join(df: DataFrame, condition: str, left: str = "a", right: str = "b", how: str = "inner") -> DataFrame:
    """Join a table with itself under two aliases; ``condition`` uses them. It should hold an equality."""
    return df.alias(left).join(df.alias(right), F.expr(condition), join_type(how))


def theta_join(left: DataFrame, right: DataFrame, condition: str | Column, how: str = "inner") -> DataFrame:
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return left.join(right, cond, join_type(how))


def range_join(points: DataFrame, ranges: DataFrame, *, point: str, low: str, high: str, width: float,
               on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows with ``low <= point < high`` (and equal ``on`` keys), without a nested loop; ``how`` = inner | left | right | full.

    Points and ranges meet in buckets. A range up to ``width`` long is listed in the one or two buckets
    of that size it touches, a longer one on the level whose buckets, twice as wide on each level,
    first reach its length; a point is listed once per level in use. So no range is listed more than
    twice, the join is an equi-join, and AQE can split a crowded bucket.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"range_join takes inner, left, right or full, not {how!r}")
    every_range = ranges
    length = (F.col(high) - F.col(low)).cast("double") / width
    ranges = ranges.filter(F.col(low) < F.col(high)).withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(length))).cast("int"))
    levels = sorted(r["__level"] for r in ranges.select("__level").distinct().collect())      # about a thousand exist for doubles

    def bucket(c: str, level: Column) -> Column:
        return F.floor(F.col(c) / (F.pow(F.lit(2.0), level) * width)).cast("long")

    first, last = bucket(low, F.col("__level")), bucket(high, F.col("__level"))
    r = ranges.withColumn("__bucket_r", F.explode(F.array_distinct(F.array(first, last)))).withColumnRenamed("__level", "__level_r")
    p = points.withColumn("__level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("__bucket", bucket(point, F.col("__level")))
    cond = (p["__level"] == r["__level_r"]) & (p["__bucket"] == r["__bucket_r"]) & (p[point] >= r[low]) & (p[point] < r[high])
    for k in on:
        cond = cond & (p[k] == r[k])
    joined = p.join(r, cond, "inner").drop("__level", "__bucket", "__level_r", "__bucket_r")
    for k in on:
        joined = joined.drop(r[k])
    # Whether a point has a range, or a range a point, depends on its position and keys alone.
    lonely = []
    if how in ("left", "full"):
        lonely.append(_without(points, joined, [point, *on]))
    if how in ("right", "full"):
        lonely.append(_without(every_range, joined, [low, high, *on]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lonely, joined)


def _without(df: DataFrame, joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose values in ``columns`` are nowhere in ``joined``; NULLs count as values."""
    met = joined.select(*[F.col(k).alias(f"__{k}") for k in columns]).distinct()
    return df.join(met, reduce(lambda a, b: a & b, [df[k].eqNullSafe(met[f"__{k}"]) for k in columns]), "left_anti")


def overlap_join(left: DataFrame, right: DataFrame, *, left_range: tuple[str, str], right_range: tuple[str, str], width: float,
                 on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs of half-open ranges that share a point (and equal ``on`` keys), each pair once; ``how`` = inner | left | right | full.

    Two ranges overlap exactly if the later one starts inside the earlier one. So the starts of the right side meet the left
    ranges, and the starts of the left side the right ranges where they are strictly later: two range joins on bucket
    levels, whatever the lengths. Empty ranges overlap nothing; the other columns of both sides have names of their own.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"overlap_join takes inner, left, right or full, not {how!r}")
    (a, b), (c, d) = left_range, right_range
    names = [*left.columns, *[x for x in right.columns if x not in on]]
    lefts, rights = left.filter(F.col(a) < F.col(b)), right.filter(F.col(c) < F.col(d))
    inside = range_join(rights, lefts, point=c, low=a, high=b, width=width, on=on).select(*names)
    around = range_join(lefts, rights, point=a, low=c, high=d, width=width, on=on).filter(F.col(a) > F.col(c)).select(*names)
    joined = inside.unionByName(around)
    lonely = []
    if how in ("left", "full"):
        lonely.append(_without(left, joined, [a, b, *on]))
    if how in ("right", "full"):
        lonely.append(_without(right, joined, [c, d, *on]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), lonely, joined)


def zip_rows(left: DataFrame, right: DataFrame, *, left_order, right_order, policy: str = "truncate") -> DataFrame:
    """Pair two tables by row number. ``policy`` = truncate | pad | fail (on unequal length)."""
    a = window(left, [WindowFn("row_number", "__ra")], order_by=left_order)
    b = window(right, [WindowFn("row_number", "__rb")], order_by=right_order)
    joined = a.join(b, a["__ra"] == b["__rb"], "inner" if policy == "truncate" else "full")
    if policy == "fail":
        uneven = F.col("__ra").isNull() | F.col("__rb").isNull()
        joined = joined.filter(F.when(uneven, F.raise_error(F.lit("tables differ in length"))).otherwise(F.lit(True)))
    return joined.withColumn("row_no", F.coalesce("__ra", "__rb")).drop("__ra", "__rb")


# ------------------------------------------------------------------ approximate text matching


def soundex_match(df: DataFrame, reference: DataFrame, *, column: str, ref_column: str) -> DataFrame:
    """Pairs of distinct values with equal Soundex code."""
    a = df.select(F.col(column).alias("value")).distinct().withColumn("code", F.soundex("value"))
    b = reference.select(F.col(ref_column).alias("match")).distinct().withColumn("code", F.soundex("match"))
    return a.join(b, "code").select("value", "match", "code")


def _deletions(c: Column, n: int) -> Column:
    """The text itself and everything reachable by deleting up to ``n`` characters."""
    found = F.array(c)
    level = found
    for _ in range(n):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        found = F.array_union(found, level)
    return found


def levenshtein_match(df: DataFrame, reference: DataFrame, *, column: str, ref_column: str, max_distance: int = 1) -> DataFrame:
    """All pairs of distinct values within ``max_distance`` edits.

    Two texts within k edits share a text reachable from both by at most k deletions, so the
    candidates come from an equi-join on those variants: exact, and no block compares all pairs.
    Meant for short values (names, codes), since a text of n characters has about n^k variants.
    """
    def variants(frame, name, out):
        return frame.select(F.col(name).alias(out)).distinct().withColumn("__v", F.explode(_deletions(F.col(out), max_distance)))
    pairs = variants(df, column, "value").join(variants(reference, ref_column, "match"), "__v").select("value", "match").distinct()
    return pairs.withColumn("distance", F.levenshtein("value", "match")).filter(F.col("distance") <= max_distance)


def best_match(df: DataFrame, reference: DataFrame, *, column: str, ref_column: str, threshold: float = 0.8, phonetic: bool = False) -> DataFrame:
    """The most similar reference text of each distinct value, if it reaches ``threshold``: (value, match, score).

    The score is 1 - edits / length of the longer text, from 0 to 1; among equal scores the smallest text wins.
    ``phonetic`` compares only texts of equal Soundex code. No block compares all its pairs: a text of length n can only
    be reached within e = (1 - threshold) / threshold * n edits, so of e + 1 pieces of a reference text one stands
    unchanged, and at most e places away, in any value that reaches the threshold. Pieces are joined on text, number and
    length (and code), which loses no pair; thresholds of 0.5 and less leave no pieces and are refused. NULL matches nothing.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    code = F.soundex if phonetic else (lambda c: F.lit(""))
    t, edits = float(threshold), lambda n: f"CAST(floor({n} * {1 - threshold}D / {threshold}D + 1e-9D) AS INT)"
    first, last = (lambda n, i: f"CAST(floor({i} * {n} / ({edits(n)} + 1)) AS INT)"), (lambda n, i: f"CAST(floor(({i} + 1) * {n} / ({edits(n)} + 1)) AS INT)")
    a = df.select(F.col(column).alias("value")).distinct().filter("value IS NOT NULL").withColumn("__n", F.length("value")).withColumn("__c", code(F.col("value")))
    b = reference.select(F.col(ref_column).alias("match")).distinct().filter("match IS NOT NULL").withColumn("__n", F.length("match")).withColumn("__c", code(F.col("match")))
    piece = f"""transform(sequence(0, {edits('__n')}), i -> struct(__n AS n, i AS i, substring(match, {first('__n', 'i')} + 1, {last('__n', 'i')} - {first('__n', 'i')}) AS x))"""
    # Per length of a reference text, per piece: the texts at every place the piece may have moved to.
    low, high = f"greatest(0, {first('l', 'i')} - {edits('l')})", f"least(__n - ({last('l', 'i')} - {first('l', 'i')}), {first('l', 'i')} + {edits('l')})"
    places = f"""flatten(transform(sequence(CAST(ceil(__n * {t}D - 1e-9D) AS INT), CAST(floor(__n / {t}D + 1e-9D) AS INT)), l ->
        flatten(transform(sequence(0, {edits('l')}), i -> IF({low} > {high}, array(),
            transform(sequence({low}, greatest({low}, {high})), s -> struct(l AS n, i AS i, substring(value, s + 1, {last('l', 'i')} - {first('l', 'i')}) AS x)))))))"""
    left = a.withColumn("__p", F.explode(F.array_distinct(F.expr(places)))).select("value", "__c", "__p")
    right = b.withColumn("__p", F.explode(F.expr(piece))).select("match", "__c", "__p")
    pairs = left.join(right, ["__c", "__p"]).select("value", "match").distinct()
    longest = F.greatest(F.length("value"), F.length("match"), F.lit(1))
    scored = pairs.withColumn("score", 1 - F.levenshtein("value", "match") / longest).filter(F.col("score") >= F.lit(t - 1e-9))
    return scored.groupBy("value").agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), F.col("match"))).alias("b")).select("value", "b.match", "b.score")


def ngrams(c: Column, n: int = 3) -> Column:
    padded = F.lower(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))),
                                        lambda i: F.substring(padded, i, F.lit(n))))


def ngram_match(df: DataFrame, reference: DataFrame, *, column: str, ref_column: str, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """All pairs of distinct values whose n-gram sets have Jaccard similarity >= ``threshold``.

    Prefix filter: with grams ordered from rare to common, a qualifying pair must share a gram among
    the first size - ceil(threshold * size) + 1 of each side. Only those grams are joined on, which
    leaves the common grams (the hot keys) out without losing a pair.
    """
    a = df.select(F.col(column).alias("value")).distinct().withColumn("ga", ngrams(F.col("value"), n))
    b = reference.select(F.col(ref_column).alias("match")).distinct().withColumn("gb", ngrams(F.col("match"), n))
    freq = (a.select(F.explode("ga").alias("g")).unionAll(b.select(F.explode("gb").alias("g")))
            .groupBy("g").agg(F.count(F.lit(1)).alias("f")))

    def prefix(frame, value, grams):
        size = F.size(grams)
        keep = (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
        listed = frame.select(value, grams, F.explode(grams).alias("g")).join(freq, "g")
        ranked = listed.groupBy(value, grams).agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("o"))
        return ranked.withColumn("p", F.explode(F.slice(F.col("o"), F.lit(1), keep))).select(value, grams, F.col("p.g").alias("g"))

    pairs = prefix(a, "value", "ga").join(prefix(b, "match", "gb"), "g").select("value", "match", "ga", "gb").distinct()
    shared = F.size(F.array_intersect("ga", "gb"))
    similarity = shared / (F.size("ga") + F.size("gb") - shared)
    return pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("value", "match", "similarity")

