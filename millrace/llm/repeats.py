"""Substring dedup: remove words inside passages that an earlier document has too.

A window is ``WINDOW`` consecutive words of one document. A word goes when a window that covers it
has the same words as a window of a document with a smaller id. Windows are judged on the input.

Method: suffix trees over words, partitioned by prefixes of variable length.

* A suffix starts at every window, but only those that can lie on a deep internal node are kept.
  The *anchor* of a window is the smallest hash among its ``ANCHOR``-word runs. Equal windows have
  equal anchors, so the suffixes of one anchor form one partition, and consecutive windows with
  the same anchor travel as one run. About one run per 18 words is left.
* A partition whose anchor occurs in one document alone has no repeat and goes first. Runs that
  agree as a whole are one path of the tree; the smallest document on it stands for all.
* Partitions that branch are read again as texts. Those of at most ``group_runs`` runs are packed
  into buckets that fit one task; a subtree is the sorted array of its suffixes, and the nodes
  ``WINDOW`` words deep with several documents below are the repeats. Larger partitions are split
  by the longest prefix that matters, the window itself, where the smallest document is a
  map-side combined aggregate. So no partition has to fit one task.

Word runs that decide a removal compare by two 64-bit hashes (anchor and run) or as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import col, picked
from millrace.llm.text import WORD_BASE, lists, pieces, run_hash, run_sums, signed, word_hashes, word_spans
from millrace.session import materialise

WINDOW = 50
ANCHOR = 16
GROUP_RUNS = 512
BUCKET_RUNS = 4096

RUN_BASE = 0xA0761D6478BD642F
PACKED = "id bigint, t int, words bigint, packed binary, g array<bigint>, i0 array<int>, n array<int>, h array<bigint>"
OUT = "id bigint, t int, n_words bigint, n_removed bigint, kept string"


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    m, w = a, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return m if w == width else np.minimum(m[:len(m) - (width - w)], m[width - w:])


def anchored_runs(hashes: np.ndarray, first_word: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first window, windows, anchor, hash of all words covered."""
    rows = np.repeat(np.arange(len(first_word) - 1), np.maximum(0, np.diff(first_word) - window + 1))
    empty = np.zeros(0, np.int64)
    if not len(rows):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = np.arange(len(hashes) - anchor + 1)
    least = sliding_min(run_hash(run_sums(hashes, WORD_BASE), grams, grams + anchor), window - anchor + 1)
    counts = np.maximum(0, np.diff(first_word) - window + 1)
    starts = np.repeat(first_word[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(rows))
    values = least[starts]
    heads = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (rows[1:] != rows[:-1]))))
    sizes = np.diff(np.concatenate((heads, [len(rows)])))
    at = starts[heads]
    whole = run_hash(run_sums(hashes, RUN_BASE), at, at + sizes + window - 1)
    return rows[heads], at - first_word[rows[heads]], sizes, values[heads], whole


def _pack(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            for a, b, offsets, data in pieces(batch.column(1)):
                starts, ends, first_word = word_spans(data, offsets)
                row, i0, n, g, h = anchored_runs(word_hashes(data, starts, ends), first_word, window, anchor)
                counts = np.bincount(row, minlength=b - a)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(first_word), pa.int64()),
                    pa.array([squeeze.compress(raw[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary()),
                    lists(signed(g), counts, pa.int64()), lists(i0, counts, pa.int32()), lists(n, counts, pa.int32()), lists(signed(h), counts, pa.int64()),
                ], names=["id", "t", "words", "packed", "g", "i0", "n", "h"])
    return run


def _words(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


def _texts(window: int):
    """The words of each listed run as one text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                found = []
                for doc, t, packed, runs in zip(*(batch.column(k).slice(row, 64).to_pylist() for k in range(4))):
                    words = _words(packed)
                    found += [(r["g"], doc, t, r["i0"], b" ".join(words[r["i0"]:r["i0"] + r["n"] + window - 1]).decode()) for r in runs]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["g", "id", "t", "i0", "words"])
    return run


def _subtrees(window: int):
    """Repeats below the prefixes of one bucket: sorted suffixes, and nodes ``window`` words deep with a smaller document."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs = [t.split(" ") for t in frame["words"]]
        codes, _ = pd.factorize(np.array([w for r in runs for w in r], object))
        codes = codes.astype(">u4")
        lengths = np.array([len(r) for r in runs])
        windows = lengths - window + 1
        begins = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        owner = np.repeat(np.arange(len(runs)), windows)
        suffixes = np.lib.stride_tricks.sliding_window_view(codes, window)[begins]
        key = np.ascontiguousarray(suffixes).view(np.dtype((np.void, 4 * window))).ravel()
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        node = np.cumsum(new) - 1
        ids = frame["id"].to_numpy()[owner]
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[node]
        hit = np.sort(order[least < ids[order]])
        start = frame["i0"].to_numpy()[owner[hit]] + begins[hit] - (np.cumsum(lengths) - lengths)[owner[hit]]
        return pd.DataFrame({"id": ids[hit], "t": frame["t"].to_numpy()[owner[hit]], "start": start.astype(np.int32), "n": np.full(len(hit), window, np.int32)})
    return run


def _leaves(window: int):
    """Every window of the listed runs under its own prefix, as two 64-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in pieces(batch.column(4)):
                starts, ends, first_word = word_spans(data, offsets)
                hashes = word_hashes(data, starts, ends)
                counts = np.diff(first_word) - window + 1
                row = np.repeat(np.arange(b - a), counts)
                step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = first_word[row] + step
                cols = [np.asarray(batch.column(k).slice(a, b - a))[row] for k in range(4)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(cols[0]), pa.array(signed(run_hash(run_sums(hashes, WORD_BASE), at, at + window))), pa.array(signed(run_hash(run_sums(hashes, RUN_BASE), at, at + window))),
                    pa.array(cols[1]), pa.array(cols[2]), pa.array((cols[3] + step).astype(np.int32), pa.int32()),
                ], names=["g", "w1", "w2", "id", "t", "start"])
    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ts, counts, packed, spans = (batch.column(k).to_pylist() for k in range(5))
        for a in range(0, len(ids), 256):
            removed, kept = [], []
            for n, z, s in zip(counts[a:a + 256], packed[a:a + 256], spans[a:a + 256]):
                words = _words(z)
                if s:
                    ends = np.zeros(n + 1, np.int64)
                    np.add.at(ends, [x["start"] for x in s], 1)
                    np.add.at(ends, [x["start"] + x["n"] for x in s], -1)
                    keep = np.cumsum(ends[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:a + 256], pa.int64()), pa.array(ts[a:a + 256], pa.int32()), pa.array(counts[a:a + 256], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "t", "n_words", "n_removed", "kept"])


def repeated_spans(packed: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``(id, t, start, n)``: word spans covered by repeated windows of later documents. ``packed`` is a stored table."""
    runs = packed.select("id", "t", F.explode(F.arrays_zip("g", "i0", "n", "h")).alias("r")).select("id", "t", "r.*")
    shared = runs.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("g")
    runs = materialise(runs.join(shared, "g"), "repeats-runs")
    paths = materialise(runs.groupBy("g", "h").agg(F.min("id").alias("first")), "repeats-paths")
    on_path = runs.join(paths, ["g", "h"])
    whole = on_path.filter("first < id").select("id", "t", F.col("i0").alias("start"), (F.col("n") + (window - 1)).alias("n"))

    branching = paths.groupBy("g").agg(F.count("*").alias("paths")).filter("paths > 1")
    heads = materialise(on_path.filter("first = id").join(branching.select("g"), "g").select("g", "id", "t", "i0", "n"), "repeats-heads")
    sizes = heads.groupBy("g").agg(F.count("*").alias("size"))
    listed = heads.groupBy("id", "t").agg(F.collect_list(F.struct("g", "i0", "n")).alias("runs"))
    texts = packed.select("id", "t", "packed").join(listed, ["id", "t"]).select("id", "t", "packed", "runs").mapInArrow(_texts(window), "g bigint, id bigint, t int, i0 int, words string")
    texts = materialise(texts.join(materialise(sizes, "repeats-sizes"), "g"), "repeats-texts")
    small = texts.filter(F.col("size") <= group_runs)
    buckets = max(1, -(-small.count() // bucket_runs))
    found = small.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"), "id", "t", "i0", "words").groupBy("bucket").applyInPandas(_subtrees(window), "id bigint, t int, start int, n int")
    leaves = texts.filter(F.col("size") > group_runs).select("g", "id", "t", "i0", "words").mapInArrow(_leaves(window), "g bigint, w1 bigint, w2 bigint, id bigint, t int, start int")
    leaves = materialise(leaves, "repeats-leaves")
    least = materialise(leaves.groupBy("g", "w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi"), "repeats-least")
    split = leaves.join(least, ["g", "w1", "w2"]).filter("lo < id").select("id", "t", "start", F.lit(window).alias("n"))
    return whole.union(found).union(split)


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, anchor: int = ANCHOR, group_runs: int = GROUP_RUNS, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``(id, t, n_words, n_removed, kept)`` for every row; ``t`` is Spark's hash of the text, and ``kept`` has the kept words joined by one space.

    Null or empty texts have no words and give an empty ``kept``. Texts under ``window`` words lose
    nothing. Rows with a null id are compared with nobody and keep everything. Of repeated windows
    inside one document, or under one id, none goes; rows of one id with different texts are looked at each. An empty table gives an empty table; other
    columns, whatever their names, are not read.
    """
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text", F.hash("text").alias("t"))
    packed = materialise(docs.mapInArrow(_pack(window, anchor), PACKED), "repeats-packed")
    spans = repeated_spans(packed.filter("id IS NOT NULL"), window, group_runs, bucket_runs)
    # Only texts travel to the spans; one list per document, never longer than its text.
    spans = spans.groupBy("id", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return packed.select("id", "t", "words", "packed").join(spans, ["id", "t"], "left").select("id", "t", "words", "packed", "spans").mapInArrow(_remove, OUT)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, without repeated words.

    Texts that lose nothing stay as they are, byte for byte; others become their kept words, joined by
    one space; rows that lose every word go.
    """
    kept = drop_repeats(df, id_col, text_col, **options).filter("n_removed > 0").select("id", "t", "kept").dropDuplicates(["id", "t"])
    whole = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(id_col).cast("bigint").alias("id"), F.hash(col(text_col)).alias("t"))
    text = F.coalesce("kept", F.col("row").getField(text_col))
    joined = whole.join(kept, ["id", "t"], "left").filter("kept IS NULL OR kept <> ''")
    return joined.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns])


def digest(kept: DataFrame) -> DataFrame:
    """The query's form of ``drop_repeats``."""
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
