"""Prefix trie of conversations with totals of every subtree.

A node is a distinct sequence of first turns. Its key is made of running sums over the digests of
(depth, turn), so every turn of every conversation knows its node and its node's parent without a
join, and a conversation of any length is cut like any other window. A node is represented by the
smallest conversation that starts with it.

Method of the totals: depth-band rollup. The depths are cut into bands of ``BAND`` levels. Inside a
band a node's values are exploded to its ancestors down to the band's top, at most ``BAND`` rows per
node, found in the chain of its conversation. The tops of the bands, with the totals of their band,
form a trie that is ``BAND`` times lower, whose totals are found in the same way; then each top's
completed total goes to its ancestors in the band above. The rounds are the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.operators import windows
from millrace.operators.windows import WindowFn
from millrace.session import materialise

BAND = 16
PIECE_IDS = 4096           # ids joined to one text before they are hashed in order
BORROW_FROM = 20
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "x", "y"]


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, k, same, words)``: the turns of every conversation, numbered from 1, with a digest of role and text and the words of the text."""
    rows = picked(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = materialise(rows.select(F.col("conv").cast("bigint").alias("conv"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("same"),
                                   F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")), "trie-turns")
    return windows.window(rows, [WindowFn("row_number", "k")], partition_by=["conv"], order_by=[("turn", "asc", "first"), "same"], stable_input=True).drop("turn")


def rebuilt(numbered: DataFrame, every: int = BORROW_FROM) -> DataFrame:
    """``(conv, depth, same, words, last)``: conversations that share openings, from ``turns``; depth 0 is a row of its own.

    Conversation c takes the first h turns of conversation ``c - c % every`` (what there is of them) in place of its own first
    h, with ``h = crc32(decimal c) % 4`` (a remainder has the sign of c). ``last`` marks the turn, or the row of depth 0, with which a conversation ends.
    """
    numbered = materialise(numbered, "trie-numbered")
    sizes = numbered.groupBy("conv").agg(F.max("k").alias("n"))
    convs = sizes.select("conv", "n", (F.crc32(F.col("conv").cast("string")) % 4).alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialise(convs.withColumn("size", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("base_n", "n"), "trie-conversations")
    heads = numbered.filter(F.col("conv") % every == 0).filter("k <= 3").withColumnRenamed("conv", "base")
    borrowed = convs.filter("got > 0").join(heads, "base").filter("k <= got").withColumn("depth", F.col("k"))
    own = numbered.join(convs, "conv").filter("k > h").withColumn("depth", F.col("k") - F.col("h") + F.col("got"))
    tops = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("same"), F.lit(0).cast("bigint").alias("words"), (F.col("size") == 0).alias("last"))
    shape = ["conv", "depth", "same", "words", (F.col("depth") == F.col("size")).alias("last")]
    return borrowed.select(*shape).unionByName(own.select(*shape)).unionByName(tops)


def _joined(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseXOR(b)


def chains(rows: DataFrame) -> DataFrame:
    """``(conv, depth, x, y, up_x, up_y, words, last)``: every turn's node and its parent's, from ``(conv, depth, same, words, last)``.

    (x, y) mixes four running sums of 32 bits of digest each; equal sequences have equal keys. Depth 0 has the key (0, 0).
    """
    one, two = F.xxhash64(F.lit(1), "depth", "same"), F.xxhash64(F.lit(2), "depth", "same")
    low = F.lit((1 << 32) - 1)
    parts = {"a": one.bitwiseAND(low), "b": F.shiftrightunsigned(one, 32), "c": two.bitwiseAND(low), "d": F.shiftrightunsigned(two, 32)}
    parts = {k: F.when(F.col("depth") > 0, v).otherwise(F.lit(0)).cast("bigint") for k, v in parts.items()}
    rows = materialise(rows.select("conv", "depth", "words", "last", *[v.alias(k) for k, v in parts.items()]), "trie-rows")
    summed = windows.window(rows, [WindowFn("sum", f"s{k}", k) for k in parts], partition_by=["conv"], order_by=["depth"], frame=windows.RUNNING_ROWS, stable_input=True)
    before = {k: F.col(f"s{k}") - F.col(k) for k in parts}
    return summed.select("conv", "depth", _joined(F.col("sa"), F.col("sb")).alias("x"), _joined(F.col("sc"), F.col("sd")).alias("y"),
                         _joined(before["a"], before["b"]).alias("up_x"), _joined(before["c"], before["d"]).alias("up_y"), "words", "last")


def subtree_sums(nodes: DataFrame, chain: DataFrame, names: list[str], band: int = BAND) -> DataFrame:
    """``(depth, x, y, *names)``: the values of ``nodes(conv, depth, x, y, *names)`` summed over every subtree.

    ``chain(conv, depth, x, y)`` has the nodes on the way from the root to each node, along its conversation.
    """
    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in names])

    in_band = F.floor(F.col("depth") / band)
    steps = chain.select("conv", in_band.alias("band"), *KEY)
    values = nodes.select("conv", in_band.alias("band"), F.col("depth").alias("of"), *names)
    found = materialise(sums(values.join(steps, ["conv", "band"]).filter("depth <= of")), "trie-bands")
    if nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"] < band:
        return found
    lower = (F.col("depth") / band).cast("bigint").alias("depth")
    tops = found.filter(F.col("depth") % band == 0).join(nodes.select("conv", *KEY), KEY)
    tops = materialise(tops.select("conv", lower, "x", "y", *names), "trie-tops")
    shorter = materialise(chain.filter(F.col("depth") % band == 0).select("conv", lower, "x", "y"), "trie-chain")
    whole = subtree_sums(tops, shorter, names, band)
    above = whole.filter("depth > 0").join(tops.select("conv", *KEY), KEY).select("conv", (F.col("depth") - 1).alias("band"), *names)
    return materialise(sums(found.unionByName(above.join(steps, ["conv", "band"]).select(*KEY, *names))), "trie-sums")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each key, which come one after the other; nothing but the hash's state is held."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in now] + [pa.array([state.hexdigest()])], names=[*KEY, "sha"])

    for batch in batches:
        for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now:
                    yield row()
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if now:
        yield row()


def ends_hashes(chain: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """``(depth, x, y, sha)``: SHA-256 of the ascending, comma-joined conversations that end at a node.

    Ids are joined to pieces of ``piece_ids`` wherever they are; only the pieces of a node follow each other through one hash,
    which is sequential by its nature, as a stream.
    """
    ends = materialise(chain.filter("last").select(*KEY, "conv"), "trie-ends")
    ranked = windows.window(ends, [WindowFn("row_number", "nr")], partition_by=KEY, order_by=["conv"], stable_input=True)
    pieces = ranked.groupBy(*KEY, F.floor((F.col("nr") - 1) / piece_ids).alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("convs"))
    texts = pieces.select(*KEY, "piece", F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("text"))
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "text").mapInArrow(_hashed, "depth bigint, x bigint, y bigint, sha string")


def prefix_trie(rows: DataFrame, band: int = BAND) -> DataFrame:
    """Every node of the trie of ``rows(conv, depth, same, words, last)`` (see ``rebuilt``), depth 0 included.

    conv: the smallest conversation that starts with the node; parent_conv: its parent's (root: null); n_convs; n_children;
    n_leaves: childless nodes of its subtree, itself included; saved: over its subtree, the words of each node's last turn times
    the conversations beyond its first; ends_sha256: of the conversations that end there. No rows, no nodes.
    """
    chain = materialise(chains(rows), "trie-chains")
    nodes = materialise(chain.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                                F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y")), "trie-nodes")
    below = nodes.filter("depth > 0")
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "trie-children")
    valued = nodes.select("conv", *KEY, (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_sums(valued, chain.select("conv", *KEY), ["n_leaves", "saved"], band)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv").alias("parent_conv"))
    # Children of one parent are many: adaptive execution splits them, each parent is one row.
    known = nodes.join(totals, KEY).join(ends_hashes(chain), KEY, "left").withColumnRenamed("conv", "own")
    known = known.join(parents.withColumnRenamed("depth", "at"), (F.col("depth") == F.col("at")) & (known["up_x"] == parents["up_x"]) & (known["up_y"] == parents["up_y"]) & (F.col("depth") > 0), "left")
    return known.select(F.col("own").alias("conv"), "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, band: int = BAND) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table of turns.

    Null roles and texts count as empty, null turns come first, turns of equal number (repeated rows too) are separate turns
    in the order of a digest of role and text; rows without conversation belong to none; an empty table has no nodes, not
    even a root. Other columns are not read.
    """
    return prefix_trie(rebuilt(turns(df)), band)


def digest(trie: DataFrame) -> DataFrame:
    """The query's form of ``conversation_trie``."""
    return trie.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
