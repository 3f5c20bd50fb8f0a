"""Benchmark decontamination: passages within an edit distance of a benchmark item, in words.

A document is contaminated by an item of ``m`` words if some run of its words can be turned into
the item with at most ``floor((1 - SIMILARITY) * m)`` insertions, deletions and replacements of
words (A-Z read as a-z).

Method: windows as long as the item are embedded by the CGK random walk, which maps edit distance
to Hamming distance: a pointer walks the words, each step writes the word it stands on, and a
random bit of (step, word) says whether it moves on. ``REPEATS`` times ``SAMPLED`` written words
are drawn at fixed random steps (bit-sampling LSH); a window and an item that agree on one of
these draws are a candidate pair, and an exact edit distance decides.

Embedding every window of every length would read the corpus many times, so windows are proposed
first, without loss: within ``e`` edits an item keeps a run of at least ``(m - e) / (e + 1)`` of
its words, so only windows laid over a common run of that length can qualify; and it keeps
``m - e`` words in all, so the text around must hold that many words of the item. Windows near an
edge of the document, where the item may lack words that no window inside it makes up for, are few
and are verified without the draws.

The benchmark is the stated query set. It is read in blocks of ``BLOCK_WORDS`` words, each small
enough to send to all tasks, against all documents; the corpus is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from millrace.llm.columns import col, picked
from millrace.llm.text import WORD_BASE, mixed, pieces, ranges, run_hash, run_sums, word_hashes, word_spans
from millrace.session import materialise

SIMILARITY = 0.8
MIN_WORDS = 5
REPEATS = 32
SAMPLED = 2
BLOCK_WORDS = 500_000
PIECE_BYTES = 1 << 20
WINDOWS_AT_ONCE = 8192      # walks are as many arrays of REPEATS numbers
FOUND = "id bigint, item bigint, start bigint, n_words bigint, distance int"


def allowed_edits(m: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * m + 1e-9)


def best_run(words: list[int], item: list[int], most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the run of ``words`` nearest to the item, the first and shortest of equals; None beyond ``most``."""
    for k in range(len(words) - len(item) + 1):
        if words[k] == item[0] and words[k:k + len(item)] == item:
            return 0, k, k + len(item)
    cost, begin = [0] * (len(words) + 1), list(range(len(words) + 1))
    for i, x in enumerate(item, 1):
        new_cost, new_begin = [i], [begin[0]]
        for j, w in enumerate(words, 1):
            # Of equal costs the later start, hence the shorter run.
            c, neg = min((cost[j - 1] + (x != w), -begin[j - 1]), (cost[j] + 1, -begin[j]), (new_cost[j - 1] + 1, -new_begin[j - 1]))
            new_cost.append(c)
            new_begin.append(-neg)
        cost, begin = new_cost, new_begin
    least = min(cost)
    if least > most:
        return None
    end = cost.index(least)
    return least, begin[end], end


def walk(words: np.ndarray, starts: np.ndarray, length: int, repeats: int) -> Iterator[np.ndarray]:
    """CGK embeddings of the runs ``words[start:start + length]``: for each of ``2 * length`` steps what the walks [run, repeat] write, zero past the end."""
    at = np.zeros((len(starts), repeats), np.int64)
    salts = (np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    starts = starts[:, None]
    for step in range(2 * length):
        here = np.where(at < length, words[starts + np.minimum(at, length - 1)], np.uint64(0))
        yield here
        at += (mixed(here + salts + np.uint64(step * 0xC2B2AE3D27D4EB4F % (1 << 64))) & np.uint64(1)).astype(np.int64)


def sampled_keys(words: np.ndarray, starts: np.ndarray, length: int, repeats: int = REPEATS, sampled: int = SAMPLED) -> np.ndarray:
    """[run, repeat]: a hash of the words that the walk of each repeat wrote at its sampled steps (a walk is usually over after 2 * length steps)."""
    wanted = np.random.default_rng((length, repeats)).integers(0, 2 * length, (repeats, sampled))
    keys = np.tile(np.arange(1, repeats + 1, dtype=np.uint64), (len(starts), 1))
    for step, written in enumerate(walk(words, starts, length, repeats)):
        for r in np.flatnonzero((wanted == step).any(axis=1)).tolist():
            keys[:, r] = mixed(keys[:, r] * np.uint64(WORD_BASE) + written[:, r] + np.uint64(step))
    return keys


@dataclass
class Items:
    """A block of benchmark items with their common-run index and sampled keys."""

    ids: list[int]
    words: list[np.ndarray]
    edits: list[int]
    keys: list[np.ndarray] = field(default_factory=list)
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)    # run length: sorted hashes, item, offset
    members: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))                 # sorted hashes of (item, word)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], similarity: float, min_words: int) -> Items:
        column = pa.array([t for _, t in rows], pa.string())
        words: list[np.ndarray] = []
        for a, b, offsets, data in pieces(column):
            starts, ends, first = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends, folded=True)
            words += [hashes[x:y] for x, y in zip(first[:-1], first[1:])]
        keep = [k for k, w in enumerate(words) if len(w) >= max(1, min_words)]
        items = cls([rows[k][0] for k in keep], [words[k] for k in keep], [allowed_edits(len(words[k]), similarity) for k in keep])
        found: dict[int, list] = {}
        for k, (w, e) in enumerate(zip(items.words, items.edits)):
            items.keys.append(sampled_keys(w, np.zeros(1, np.int64), len(w))[0])
            size = -(-(len(w) - e) // (e + 1))
            at = np.arange(len(w) - size + 1)
            found.setdefault(size, []).append((run_hash(run_sums(w, WORD_BASE), at, at + size), np.full(len(at), k), at))
        for size, parts in found.items():
            hashes, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            items.runs[size] = hashes[order], item[order], at[order]
        if items.words:
            items.members = np.unique(_member(np.concatenate(items.words), np.repeat(np.arange(len(items.words)), [len(w) for w in items.words])))
        return items


def _member(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mixed(words ^ mixed(item.astype(np.uint64) + np.uint64(1)))


def _hold_enough(items: Items, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether hashes[low:high] have as many words of the item as a match must keep."""
    needed = (np.array([len(w) for w in items.words]) - np.array(items.edits))[item]
    ok = np.zeros(len(item), bool)
    for a in range(0, len(item), 20_000):
        s = slice(a, a + 20_000)
        sizes = high[s] - low[s]
        wanted = _member(hashes[ranges(low[s], sizes)], np.repeat(item[s], sizes))
        known = items.members[np.minimum(np.searchsorted(items.members, wanted), len(items.members) - 1)] == wanted
        total = np.concatenate(([0], np.cumsum(known)))
        ends = np.cumsum(sizes)
        ok[s] = total[ends] - total[ends - sizes] >= needed[s]
    return ok


def _proposals(items: Items, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (document, item, window start, at an edge), distinct: windows laid over a common run, moved by up to the allowed edits.

    All windows of a run are at an edge where one of them sticks out of the document.
    """
    out = []
    sums = run_sums(hashes, WORD_BASE)
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edits, sizes = np.array(items.edits), np.array([len(w) for w in items.words])
    for size, (wanted, item, offset) in items.runs.items():
        if len(hashes) < size:
            continue
        at = np.arange(len(hashes) - size + 1)
        at = at[doc_of[at] == doc_of[at + size - 1]]
        h = run_hash(sums, at, at + size)
        low = np.searchsorted(wanted, h)
        at, low, h = (x[wanted[np.minimum(low, len(wanted) - 1)] == h] for x in (at, low, h))
        n = np.searchsorted(wanted, h, "right") - low
        which = ranges(low, n)
        at = np.repeat(at, n)
        doc, which_item = doc_of[at], item[which]
        # One proposal for each laid-over window, however many runs it shares.
        doc, which_item, start = np.unique(np.stack([doc, which_item, at - offset[which]]), axis=1)
        e, m = edits[which_item], sizes[which_item]
        ok = _hold_enough(items, hashes, np.maximum(start - e, first[doc]), np.minimum(start + m + e, first[doc + 1]), which_item)
        doc, which_item, start, e, m = doc[ok], which_item[ok], start[ok], e[ok], m[ok]
        edge = (start - e < first[doc]) | (start + m + e > first[doc + 1])
        moves = 2 * e + 1
        out.append(np.stack([np.repeat(doc, moves), np.repeat(which_item, moves), ranges(start - e, moves), np.repeat(edge, moves)], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)


def _matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, words, distance) of the best run, for each pair that the sampled keys propose."""
    pairs = _proposals(items, hashes, first)
    if not len(pairs):
        return
    hit = pairs[:, 3] > 0
    lengths = np.array([len(w) for w in items.words])[pairs[:, 1]]
    for length in np.unique(lengths[~hit]).tolist():
        every = np.flatnonzero((lengths == length) & (pairs[:, 3] == 0))
        for a in range(0, len(every), WINDOWS_AT_ONCE):
            at = every[a:a + WINDOWS_AT_ONCE]
            hit[at] = (sampled_keys(hashes, pairs[at, 2], length) == np.stack([items.keys[k] for k in pairs[at, 1]])).any(axis=1)
    kept = pairs[hit]                       # in order of document and item
    heads = np.flatnonzero(np.concatenate(([True], (kept[1:, :2] != kept[:-1, :2]).any(axis=1)))) if len(kept) else []
    for group in np.split(kept, heads[1:]) if len(kept) else ():
        (doc, item), starts = group[0, :2].tolist(), group[:, 2]
        e = items.edits[item]
        best = None
        for begin, end in _spans(starts, len(items.words[item]), e, first[doc], first[doc + 1]):
            found = best_run(hashes[begin:end].tolist(), items.words[item].tolist(), e)
            if found and (best is None or found[0] < best[0]):
                best = found[0], begin + found[1] - first[doc], found[2] - found[1]
        if best:
            yield doc, item, int(best[1]), int(best[2]), int(best[0])


def _spans(starts: np.ndarray, length: int, edits: int, low: int, high: int) -> list[tuple[int, int]]:
    """Word ranges around the windows, merged where they overlap."""
    out: list[list[int]] = []
    for s in np.sort(starts).tolist():
        a, b = max(low, s - edits), min(high, s + length + edits)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(rows: list[tuple[int, str | None]], similarity: float, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(rows, similarity, min_words)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, offsets, data in pieces(batch.column(1), PIECE_BYTES):
                starts, ends, first = word_spans(data, offsets)
                found = [(ids[a + d], items.ids[k], s, n, e) for d, k, s, n, e in _matches(items, word_hashes(data, starts, ends, folded=True), first)]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["id", "item", "start", "n_words", "distance"])
    return run


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, item, start, n_words, distance)``: for each document and item the nearest run of words, where it is near enough.

    Items under ``min_words`` words (also null and empty ones) say too little and match nothing; null
    and empty texts contain nothing. Repeated rows and items are reported each, also under a null id.
    Either table may be empty, and other columns are not read.
    """
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    found = None
    for rows in _item_blocks(benchmark, item_col, item_text_col, block_words):
        part = docs.mapInArrow(_scan(rows, similarity, min_words), FOUND)
        found = part if found is None else found.union(part)
    return found


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's rows, about ``block_words`` words at a time."""
    items = picked(benchmark, item=item_col, text=text_col).select(F.col("item").cast("bigint").alias("item"), "text")
    words = items.select(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-words // block_words))
    if blocks > 1:
        items = materialise(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "decontaminate-items")
    for k in range(blocks):
        yield [(r["item"], r["text"]) for r in (items.filter(F.col("block") == k) if blocks > 1 else items).collect()]


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, with all their columns, that contain no benchmark item. Null and empty texts stay."""
    for rows in _item_blocks(benchmark, item_col, item_text_col, block_words):
        df = df.filter(_clean(rows, similarity, min_words)(col(text_col)))
    return df


def _clean(rows: list[tuple[int, str | None]], similarity: float, min_words: int):
    @F.arrow_udf(BooleanType())
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items.of(rows, similarity, min_words)
        for texts in parts:
            ok = np.ones(len(texts), bool)
            for a, _, offsets, data in pieces(texts, PIECE_BYTES):
                starts, ends, first = word_spans(data, offsets)
                for doc, *_ in _matches(items, word_hashes(data, starts, ends, folded=True), first):
                    ok[a + doc] = False
            yield pa.array(ok)
    return clean


def leaked_pairs(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's form."""
    return find_leaks(df, benchmark).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("start_word"), "n_words", "distance")
