"""Token files: ids of a corpus as canonical, length-limited Huffman codes.

File format, a folder of Parquet files:

* ``codebook``: ``id``, ``bits`` - the code length of every id that occurs. Codes are canonical:
  they count upwards through the ids sorted by (bits, id), so lengths are all a reader needs.
* ``blocks``: whole documents of ascending ids, about ``BLOCK_IDS`` ids to a row, each decodable on its own:
  ``shard`` and ``start`` (ids before the block in its shard), ``docs`` and ``sizes`` (ids of each
  document), ``marks`` (bit offset of every ``MARK_IDS``-th id) and ``code`` (the bits, first bit first, padded with zeros).
* ``shards``: ``shard``, ``ids``.

Code lengths come from the counts of all documents (package-merge). A reader decodes with one table
that maps the next ``limit`` bits to an id and its length, all marks of many blocks in step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.llm.text import lists
from millrace.llm.tokens import encoded, tokenizer_path, unpacked
from millrace.session import materialise, scratch_path

END_ID = 2
LIMIT = 16
BLOCK_IDS = 1 << 16
MARK_IDS = 256
SHARD_IDS = 1 << 23
BLOCKS = "shard int, start bigint, docs array<bigint>, sizes array<int>, marks array<bigint>, code binary"


# ------------------------------------------------------------------ the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (more only where the ids need them); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate((weights, packages))
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, deep = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for single in reversed(levels):
        singles = int(single[:take].sum())
        deep[:singles] += 1
        take = 2 * (take - singles)
    lengths[used] = deep
    return lengths


@dataclass(frozen=True)
class Codebook:
    """Canonical codes of ids with given lengths."""

    lengths: np.ndarray

    @property
    def limit(self) -> int:
        return max(1, int(self.lengths.max(initial=0)))

    def codes(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        spans = np.uint64(1) << (self.limit - self.lengths[used]).astype(np.uint64)
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[used] = (np.cumsum(spans) - spans) >> (self.limit - self.lengths[used]).astype(np.uint64)
        return codes

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every value of the next ``limit`` bits."""
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.limit - self.lengths[used])
        ids = np.zeros(1 << self.limit, np.uint32)
        bits = np.zeros(1 << self.limit, np.int64)
        ids[:spans.sum()], bits[:spans.sum()] = np.repeat(used, spans), np.repeat(self.lengths[used], spans)
        return ids, bits


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, mark_ids: int = MARK_IDS) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` one after the other, and the bit offset of every ``mark_ids``-th."""
    sizes, values = lengths[ids], codes[ids]
    ends = np.cumsum(sizes)
    at = ends - sizes
    out = np.zeros((int(ends[-1]) + 63) // 64 + 1 if len(ids) else 0, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63) - sizes
        over = room < 0
        first = np.where(over, values >> np.maximum(-room, 0).astype(np.uint64), values << np.maximum(room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[heads]] = np.add.reduceat(first, heads)
        out[word[over] + 1] += values[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[::mark_ids]


def read_bits(code: np.ndarray, marks: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """Decode runs that begin at bit offsets ``marks`` and hold ``counts`` ids each, all runs in step."""
    ids, bits = table
    out = np.zeros((int(counts.max(initial=0)), len(marks)), np.uint32)
    at, top = marks.astype(np.int64).copy(), np.uint64(64 - limit)
    short = len(counts) and counts.min() < len(out)
    for step in range(len(out)):
        word, r = at >> 6, (at & 63).astype(np.uint64)
        seen = ((code[word] << r) | ((code[word + 1] >> np.uint64(1)) >> (np.uint64(63) - r))) >> top
        out[step] = ids[seen]
        at += bits[seen]
        if short:
            np.minimum(at, (len(code) - 2) * 64, out=at)     # runs that have ended read on in vain
    filled = np.arange(len(out))[:, None] < counts
    return out.T[filled.T]


# ------------------------------------------------------------------ writing


def _counted(vocabulary: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                counts += np.bincount(unpacked(packed.as_py()), minlength=vocabulary)
            counts[end_id] += batch.num_rows
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])
    return run


def _block(shard: int, start: int, docs: list, ids: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    code, marks = write_bits(np.concatenate(ids), codes, lengths)
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((shard, start, docs, [len(x) for x in ids], marks, code), kinds)], names=["shard", "start", "docs", "sizes", "marks", "code"])


def _blocks(lengths: np.ndarray, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end = Codebook(lengths).codes(), np.array([end_id], np.uint32)
        docs, ids, held, start, shard = [], [], 0, 0, None
        for batch in batches:
            for shard, doc, packed in zip(*(c.to_pylist() for c in batch.columns)):
                one = np.concatenate((unpacked(packed), end))
                if held and held + len(one) > block_ids:
                    yield _block(shard, start, docs, ids, codes, lengths)
                    docs, ids, held, start = [], [], 0, start + held
                docs.append(doc)
                ids.append(one)
                held += len(one)
        if docs:
            yield _block(shard, start, docs, ids, codes, lengths)
    return run


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int = END_ID, limit: int = LIMIT, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of document id.

    Null and empty texts are the end id alone. Rows with a null id come first, rows of equal id are
    ordered by their contents. An empty table writes an empty codebook. Other columns are not read.
    """
    from millrace.llm.tokens import WordEncoder

    spark, tokenizer = df.sparkSession, tokenizer or tokenizer_path()
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    tokens = materialise(docs.mapInArrow(encoded(tokenizer), "id bigint, n bigint, ids binary"), "tokens")
    vocabulary = max(WordEncoder(tokenizer).vocabulary, end_id + 1)
    counted = tokens.select("ids").mapInArrow(_counted(vocabulary, end_id), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in counted.collect():                   # at most one row per vocabulary entry
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used.astype(np.int32)), "bits": pa.array(lengths[used].astype(np.int32))})).coalesce(1).write.parquet(f"{path}/codebook")
    shards = max(1, -(-int(counts.sum()) // shard_ids))
    # AQE leaves a partition count that was asked for, so partition numbers follow the order of ids.
    ordered = tokens.repartitionByRange(shards, "id").sortWithinPartitions("id", "n", "ids")
    ordered.select(F.spark_partition_id().alias("shard"), "id", "ids").mapInArrow(_blocks(lengths, end_id, block_ids), BLOCKS).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))
    blocks.groupBy("shard").agg(F.sum("ids").alias("ids")).coalesce(1).write.parquet(f"{path}/shards")


# ------------------------------------------------------------------ reading


def _decoded(lengths: np.ndarray, digest: bool, mark_ids: int, step: int = 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        table = book.table()
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                rows = batch.slice(a, step).to_pylist()
                code = [np.frombuffer(r["code"], ">u8").astype(np.uint64) for r in rows]
                base = np.cumsum([0] + [64 * len(c) for c in code])
                marks = np.concatenate([np.array(r["marks"], np.int64) + b for r, b in zip(rows, base.tolist())])
                sizes = np.array([sum(r["sizes"]) for r in rows])
                counts = np.concatenate([np.minimum(mark_ids, n - np.arange(0, n, mark_ids)) for n in sizes.tolist()])
                ids = read_bits(np.concatenate([*code, np.zeros(2, np.uint64)]), marks, counts, table, book.limit)
                each = np.concatenate([np.array(r["sizes"], np.int64) for r in rows])
                inside = np.concatenate([r["start"] + np.cumsum(r["sizes"]) - np.array(r["sizes"]) for r in rows])
                ends = np.cumsum(each)
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * x:4 * y] for x, y in zip((ends - each).tolist(), ends.tolist())]
                last = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else lists(ids.astype(np.int32), each, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([r["shard"] for r in rows], [len(r["docs"]) for r in rows]).astype(np.int32)),
                    pa.array([d for r in rows for d in r["docs"]], pa.int64()), pa.array(inside.astype(np.int64)), pa.array(each), last,
                ], names=["shard", "id", "inside", "n", "ids"])
    return run


def read_tokens(spark: SparkSession, path: str, *, digest: bool = False, mark_ids: int = MARK_IDS) -> DataFrame:
    """``(id, start, n, ids)`` of every document in the files; with ``digest`` ``ids`` is their crc32."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()      # at most one row per vocabulary entry
    lengths = np.zeros(max(book["id"].to_pylist(), default=0) + 1, np.int64)
    lengths[book["id"].to_numpy()] = book["bits"].to_numpy()
    docs = spark.read.parquet(f"{path}/blocks").mapInArrow(_decoded(lengths, digest, mark_ids), f"shard int, id bigint, inside bigint, n bigint, ids {'bigint' if digest else 'array<int>'}")
    shards = spark.read.parquet(f"{path}/shards").collect()      # one row per shard of about SHARD_IDS ids
    before, total = {}, 0
    for row in sorted(shards):
        before[row["shard"]], total = total, total + row["ids"]
    offsets = spark.createDataFrame(list(before.items()), "shard int, before bigint")
    return docs.join(F.broadcast(offsets), "shard").select("id", (F.col("before") + F.col("inside")).alias("start"), "n", "ids")


def token_digest(df: DataFrame, path: str | None = None) -> DataFrame:
    """The query's form: write the files, read them back, one row per document."""
    path = path or scratch_path(df.sparkSession, "token-files")
    write_tokens(df, path)
    return read_tokens(df.sparkSession, path, digest=True).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("ids").alias("ids_crc32"))
