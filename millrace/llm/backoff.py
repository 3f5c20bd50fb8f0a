"""Language-model scores of documents: stupid backoff over n-grams of tokenizer ids, counted on all documents.

A document is scored by the counts of all others: its own are taken off. A token's score is the
relative count of the longest n-gram seen elsewhere, times ``ALPHA`` for every shorter order it had
to fall back to; a token that occurs nowhere else counts as half an occurrence. A document's score
is the sum of the decimal logarithms.

Method: tables joined by hash. N-grams are 64-bit hashes. Documents are tokenised once, into chunks
of about ``CHUNK_IDS`` ids. Each chunk's distinct n-grams with their counts are exploded by hash
range; one range holds the count table of its n-grams, is joined to the chunks that asked for
them, and gives back the totals; with these each chunk sums its documents. No n-gram occurs more
than once per chunk and hash range, so frequent ones are no hot keys, and neither chunks nor ranges
(about ``RANGE_GRAMS`` each) grow with the corpus. What travels is sorted, so it packs well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.llm.text import WORD_BASE, mixed, run_hash, run_sums
from millrace.llm.tokens import encoded, tokenizer_path, unpacked
from millrace.session import materialise

ORDER = 3
ALPHA = 0.4
CHUNK_IDS = 1 << 22
SLICE_IDS = 1 << 18       # a chunk is worked through in slices of documents, which bounds the memory of a task
RANGE_GRAMS = 1 << 22
SCORES = "id bigint, n_tokens bigint, score double"


def pack(values: np.ndarray, ascending: bool = True) -> bytes:
    """64-bit integers, of ascending ones the differences: equal byte positions together, compressed."""
    values = values.astype(np.uint64, copy=False)
    steps = np.diff(values, prepend=np.uint64(0)) if ascending else values
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(packed: bytes, ascending: bool = True) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values) if ascending else values


def ngrams(ids: np.ndarray, ends: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: where its n-grams end, and their hashes. ``ends`` are the documents' ends; no n-gram spans two."""
    sums = run_sums(mixed(ids.astype(np.uint64) + np.uint64(1)), WORD_BASE)
    begin = np.repeat(np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0))
    at = np.arange(len(ids))
    found = []
    for k in range(1, order + 1):
        last = at[at - begin >= k - 1]
        found.append((last, run_hash(sums, last - k + 1, last + 1)))
    return found


def _chunked(path: str, chunk_ids: int):
    """Tokenised documents with the chunk they belong to: runs of a task's rows, named after their first."""
    inner = encoded(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, 0
        for batch in inner(batches):
            names = []
            for doc, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if chunk is None or held + n > chunk_ids:
                    chunk, held = int(np.int64((zlib.crc32(ids) << 31) ^ zlib.crc32(repr(doc).encode()))), 0
                held += n
                names.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *batch.columns], names=["chunk", "id", "n", "ids"])
    return run


def _slices(ids: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``SLICE_IDS`` ids."""
    first, held = 0, 0
    for k, one in enumerate(ids):
        if held and held + len(one) > SLICE_IDS:
            yield first, k
            first, held = k, 0
        held += len(one)
    if ids:
        yield first, len(ids)


def _joined_up(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([len(x) for x in ids], dtype=np.int64)


class Slice:
    """Documents of a chunk with their n-grams: for each order where they end, the distinct ones, and which of these each is."""

    def __init__(self, ids: list[np.ndarray], order: int) -> None:
        flat, self.ends = _joined_up(ids)
        self.grams = []
        for last, h in ngrams(flat, self.ends, order):
            distinct, which = np.unique(h, return_inverse=True)
            self.grams.append((last.astype(np.int32), distinct, which.astype(np.int32)))


def gram_table(slices: list[Slice]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all orders, ascending, and how often each occurs.

    Merged one sixteenth of the hashes at a time, so that sorting needs little beside the table itself.
    """
    found = [(d, np.bincount(w, minlength=len(d)).astype(np.int32)) for s in slices for _, d, w in s.grams]
    cuts = [np.searchsorted(d, np.arange(16, dtype=np.uint64) << np.uint64(60)).tolist() + [len(d)] for d, _ in found]
    tables, totals = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for k in range(16):
        grams = np.concatenate([np.zeros(0, np.uint64), *(d[c[k]:c[k + 1]] for (d, _), c in zip(found, cuts))])
        order = np.argsort(grams)
        grams = grams[order]
        counts = np.concatenate([np.zeros(0, np.int32), *(n[c[k]:c[k + 1]] for (_, n), c in zip(found, cuts))])[order]
        heads = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
        tables.append(grams[heads])
        totals.append(np.add.reduceat(counts, heads) if len(heads) else counts)
    return np.concatenate(tables), np.concatenate(totals)


def _asked(order: int, bits: int):
    """The distinct n-grams of each chunk, by hash range."""
    def rows(chunk: int, ids: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = gram_table([Slice(ids[a:b], order) for a, b in _slices(ids)])
        part = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
        cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64), [len(part)]))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.RecordBatch.from_arrays([
            pa.array([int(part[a]) for a, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.int64()),
            pa.array([pack(grams[a:b]) for a, b in spans], pa.binary()), pa.array([pack(n[a:b], False) for a, b in spans], pa.binary()),
        ], names=["part", "chunk", "grams", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != now and ids:
                    yield rows(now, ids)
                    ids = []
                now = chunk
                ids.append(unpacked(packed))
        if ids:
            yield rows(now, ids)
    return run


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """One hash range: add up the counts of all chunks and give each chunk the totals of its n-grams, in their order."""
    grams = [unpack(x) for x in frame["grams"]]
    table, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(place, np.concatenate([unpack(x, False) for x in frame["n"]]).astype(np.float64)).astype(np.int64)
    out = []
    for chunk, rows in frame.reset_index(drop=True).groupby("chunk").groups.items():
        own = grams[rows[0]] if len(rows) == 1 else np.unique(np.concatenate([grams[r] for r in rows]))
        out.append((chunk, frame["part"].iloc[0], pack(totals[np.searchsorted(table, own)], False)))
    return pd.DataFrame(out, columns=["chunk", "part", "totals"])


def document_sums(part: Slice, table: np.ndarray, totals: np.ndarray, alpha: float, tokens: int) -> np.ndarray:
    """Scores of documents, given the totals of all their n-grams in the corpus of ``tokens`` tokens."""
    ends, order = part.ends, len(part.grams)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    counts = np.zeros((order + 1, len(doc)))            # of the n-gram that ends at each position, without the document's own
    for k, (last, distinct, which) in enumerate(part.grams, 1):
        _, place, own = np.unique(doc[last] * np.int64(max(1, len(distinct))) + which, return_inverse=True, return_counts=True)
        counts[k, last] = totals[np.searchsorted(table, distinct)][which] - own[place]
    before = np.arange(len(doc)) - (ends - sizes)[doc]     # tokens of the document before each position
    score = np.log10(np.maximum(counts[1], 0.5) / np.maximum(tokens - sizes[doc], 1))
    longest = np.minimum(before + 1, order)
    fallen = longest - 1
    for k in range(2, order + 1):
        seen = counts[k] > 0
        context = np.concatenate(([1.0], counts[k - 1][:-1]))[:len(doc)]
        score = np.where(seen, np.log10(np.where(seen, counts[k], 1) / np.where(seen, context, 1)), score)
        fallen = np.where(seen, longest - k, fallen)
    return np.bincount(doc, score + fallen * np.log10(alpha), len(ends)).astype(np.float64)


def _scored(order: int, alpha: float, tokens: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids = [unpacked(x) for x in docs["ids"].to_pylist()]
        slices = [Slice(ids[a:b], order) for a, b in _slices(ids)]
        table, _ = gram_table(slices)
        totals = np.concatenate([*(unpack(x, False) for x in found.sort_by("part")["totals"].to_pylist()), np.zeros(0, np.uint64)]).astype(np.int64)
        assert len(totals) == len(table), "a hash range is missing"
        sums = [document_sums(part, table, totals, alpha, tokens) for part in slices]
        return pa.table({"id": docs["id"], "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "score": np.concatenate([*sums, np.zeros(0)])})
    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = ORDER, alpha: float = ALPHA, tokenizer: str | None = None, chunk_ids: int = CHUNK_IDS, range_grams: int = RANGE_GRAMS) -> DataFrame:
    """``(id, n_tokens, score)`` for every row.

    Null and empty texts have no tokens and score 0. A document alone in the table meets only unseen
    tokens. Repeated rows count for each other, also under one id or a null id; an empty table gives
    an empty one; other columns are not read.
    """
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    tokens = materialise(docs.mapInArrow(_chunked(tokenizer or tokenizer_path(), chunk_ids), "chunk bigint, id bigint, n bigint, ids binary"), "backoff-tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = max(0, (order * total // range_grams).bit_length())
    asked = tokens.select("chunk", "ids").mapInArrow(_asked(order, bits), "part bigint, chunk bigint, grams binary, n binary")
    totals = asked.groupBy("part").applyInPandas(_joined, "chunk bigint, part bigint, totals binary")
    return tokens.select("chunk", "id", "ids").groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scored(order, alpha, total), SCORES)


def document_scores(df: DataFrame) -> DataFrame:
    """The query's form, with the mean per token (null without tokens)."""
    return score(df).select(F.col("id").alias("doc_id"), "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean_score"))
