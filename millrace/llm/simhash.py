"""Near copies by 64-bit SimHash fingerprints that differ in at most two bits.

Method: an inverted index of the eight bytes of a fingerprint by position. Two differing bits spoil
at most two bytes, so a link shares at least six of the eight positional bytes: pairs below six are
dropped, the rest are verified by their bits.

Two departures from a plain positional index, both exact. One positional byte has only 256 values,
so its lists would grow with the corpus and their pairs with its square. A list here stands for four
positional bytes at once, two of the four byte pairs: two spoiled bytes leave at least two pairs
whole, so each link meets in one of the six lists, and its shared bytes are counted on the pair
itself instead of adding up over lists. Equal fingerprints are one entry. Lists longer than
``list_limit`` (groups of near copies) are not paired at all: two values differ in at most two bits
exactly if some value is at most one bit away from both, so their entries meet at their 64
neighbours, which takes a fixed number of rows per entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import col, picked
from millrace.llm.components import components
from millrace.llm.text import pieces
from millrace.session import materialise

SHINGLE = 3
SEED = 42
BITS = 2
LIST_LIMIT = 64
BYTE_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included; without words it is zero."""
    words = text.lower().split()        # on bytes: A-Z only, and white space 0x20, 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]), np.uint8)
    ones = _bit_counts(hashes.reshape(-1, 8))
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the big-endian 8-byte rows have each of the 64 bits."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 255):        # sums of 255 ones still fit a byte
        ones += np.add.reduce(np.unpackbits(hashes[a:a + 255], axis=1), axis=0, dtype=np.uint8)
    return ones


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in pieces(batch.column(1)):
                raw = data.tobytes()
                found = [fingerprint(raw[x:y], shingle) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])
    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``: the fingerprint's 64 bits as a bigint."""
    return picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(_fingerprints(shingle), "id bigint, fp bigint")


def _pair(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)


def shared_bytes(a: Column, b: Column) -> Column:
    """In how many of the eight positions two fingerprints have the same byte."""
    differ = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(differ, 8 * k).bitwiseAND(0xFF) == 0).cast("int") for k in range(8))


def links(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(a, b)`` between distinct fingerprints of ``prints(fp)``, enough of them to connect all that differ in at most two bits."""
    fp = F.col("fp")
    keys = F.array(*[F.lit(k * (1 << 32)) + _pair(fp, a) * (1 << 16) + _pair(fp, b) for k, (a, b) in enumerate(BYTE_PAIRS)])
    index = prints.select("fp", F.explode(keys).alias("key"))
    sizes = materialise(index.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "simhash-lists")
    index = materialise(index.join(sizes, "key"), "simhash-index")
    short = index.filter(F.col("size") <= list_limit).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = short.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda x: x > F.col("a"))).alias("b"))
    pairs = pairs.filter(shared_bytes(F.col("a"), F.col("b")) >= 8 - BITS).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    near = F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k))))
    meet = index.filter(F.col("size") > list_limit).select("fp").distinct().select("fp", F.explode(near).alias("at"))
    least = materialise(meet.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).filter("b < z").drop("z"), "simhash-meet")
    return pairs.union(meet.join(least, "at").filter("fp <> b").select(F.col("fp").alias("a"), "b")).distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(id, fp, component)`` for every row: the smallest id reachable through links.

    Null, empty and blank texts have the fingerprint zero and link like any other. A row with a null
    id keeps its fingerprint, takes part in no group and has a null component, repeated rows stay,
    an empty table gives an empty one, and other columns are not read.
    """
    prints = materialise(fingerprints(df, id_col, text_col, shingle), "simhash-prints")
    firsts = materialise(prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    pairs = links(firsts.select("fp"), list_limit)
    edges = pairs.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), "simhash-groups")
    firsts = materialise(firsts.join(groups.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component")), "simhash-labels")
    return prints.join(firsts, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its group. Rows that share an id stay or go together, rows with a null id stay."""
    later = near_copies(df, id_col, text_col, **options).filter("id <> component").select(F.col("id").alias("__later")).distinct()
    return df.join(later, col(id_col).cast("bigint") == F.col("__later"), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The query's form of ``near_copies``."""
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
