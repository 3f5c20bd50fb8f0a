"""Periodic runs of words: maximal stretches that repeat with their smallest period.

Method: a suffix automaton over the words, and a link-cut forest over its link tree in which every
preferred path carries the position at which it was last accessed. Appending word i accesses the
state of the prefix that ends there: the path from the root is recoloured to i, and each piece that
had another colour j yields the longest string that ends both at i and, for the last time, at j (the
length of the piece's lowest state). If it is at least as long as i - j, the two occurrences touch
or overlap: a square, whose stretch is extended as far to the left as the period holds. It is a run
if the next word breaks the period. As a run of four or more periods has its longest border end one
smallest period earlier and nowhere later, every run is found once, with its smallest period.

Before that, words that cannot belong to a run are set aside, without loss: every five words within
a run occur again inside the run, at most a quarter of its length away. Stretches of such words are
narrowed until nothing changes; only these zones get an automaton. Its size follows the zone, and a
document without repeats costs a split and a sort of hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.llm.text import pieces

MIN_LENGTH = 6
MIN_EXPONENT = 4
GRAM = 5                   # words of a run that recur inside it; follows from the two limits above
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FOUND = "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"


def automaton(codes: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: each state's link and length, and the state of every prefix. The root is state 1, its link 0."""
    link, length, step, prefixes = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for c in codes:
        now = len(link)
        link.append(1)
        length.append(length[last] + 1)
        step.append({})
        prefixes.append(now)
        p = last
        while p and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return link, length, prefixes


class LinkCut:
    """Preferred paths of a rooted forest as splay trees; a path's colour stands at the root of its tree."""

    def __init__(self, parent: list[int]) -> None:
        self.up = list(parent)              # parent in the splay tree, or of the whole path
        self.left = [0] * len(parent)       # nodes nearer to the root
        self.right = [0] * len(parent)
        self.colour = [0] * len(parent)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (p := up[top]) and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        self.colour[x] = self.colour[top]
        end = up[top]
        while (p := up[x]) != end:
            if (g := up[p]) != end:
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``x``; (old colour, lowest node) of each piece that had one."""
        up, right, held = self.up, self.right, self.colour
        found, below = [], 0
        while x:
            self._splay(x)
            old = held[x]
            if old:
                found.append((old, x))
            if right[x]:
                held[right[x]] = old
            right[x] = below
            below, x = x, up[x]
        held[below] = colour
        return found


def runs_of(codes: Sequence[int], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    link, length, prefixes = automaton(codes)
    tree = LinkCut(link)
    n, found = len(codes), []
    for i, state in enumerate(prefixes, 1):
        for j, lowest in tree.access(state, i):
            period = i - j
            whole = length[lowest] + period
            if whole >= min_length and whole >= min_exponent * period and (i == n or codes[i] != codes[i - period]):
                found.append((i - whole, whole, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def zones(codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ``codes`` (words of several documents) that hold all runs of six words and four periods or more.

    Within a run of length L and period q every five words recur q away, and q <= L / 4 <= a quarter of the stretch.
    """
    place, zone = np.arange(len(codes)), doc
    if len(codes) < MIN_LENGTH:
        return []
    gram = np.zeros(len(codes), np.uint64)
    for k in range(GRAM):
        gram[:len(codes) - k] = gram[:len(codes) - k] * BASE + codes[k:].astype(np.uint64)
    while len(place) >= MIN_LENGTH:
        whole = np.flatnonzero(zone[:1 - GRAM] == zone[GRAM - 1:])
        key = gram[place[whole]] * BASE + zone[whole].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, at = key[order], whole[order]
        sizes = np.bincount(zone)
        near = (key[1:] == key[:-1]) & ((at[1:] - at[:-1]) * MIN_EXPONENT <= sizes[zone[at[1:]]])
        kept = np.zeros(len(place) + GRAM, bool)
        kept[at[1:][near]] = kept[at[:-1][near]] = True
        for k in (1, 2, 1):                    # five words from every start
            kept[k:] |= kept[:-k].copy()
        left = np.flatnonzero(kept[:len(place)])
        if not len(left):
            return []
        new = np.cumsum(np.concatenate(([True], (left[1:] != left[:-1] + 1) | (zone[left[1:]] != zone[left[:-1]])))) - 1
        if len(left) == len(place) and new[-1] + 1 == len(np.unique(zone)):
            cuts = np.flatnonzero(np.diff(new, prepend=-1))
            ends = np.concatenate((cuts[1:], [len(new)]))
            return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(cuts, ends) if b - a >= MIN_LENGTH]
        place, zone = place[left], new
    return []


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, offsets, data in pieces(batch.column(1)):
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]    # bytes: 0x20, 0x09-0x0D
            sizes = np.array([len(t) for t in texts], np.int64)
            code = defaultdict()
            code.default_factory = code.__len__
            codes = np.fromiter((code[w] for t in texts for w in t), np.int64, int(sizes.sum()))
            begin = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(texts)), sizes)
            runs: list[list] = [[] for _ in texts]
            for a, b in zones(codes, doc):
                d = int(doc[a])
                shift = a - int(begin[d])
                runs[d] += [(s + shift, length, q) for s, length, q in runs_of(codes[a:b].tolist())]
            out = [b" ".join(collapsed(t, r)) for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, last - first), pa.array(sizes),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array(out, pa.binary()).cast(pa.string()),
            ], names=["id", "n_words", "runs", "text"])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, text)`` for every row: all runs by start, then period, and the text with each run cut to its first period.

    Words of the new text are joined by one space. Null, empty and blank texts have no words, no runs and an empty text.
    Rows with null or repeated ids are documents of their own; an empty table gives an empty one; other columns are not
    read. A document is worked on as a whole, with memory in proportion to its longest zone.
    """
    return picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(_found, FOUND)


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` where documents with ``h = crc32(decimal id)``, ``h % 10 = 0``, repeat a stretch of words to their end.

    From word ``a = g % n`` on (``g = h div 10``), word i becomes word ``a + (i - a) % p`` with ``p = 1 + (n - a) div (3 + g % 8)``.
    Texts of other documents, of null ids and without words stay.
    """
    docs = picked(df, id=id_col, text=text_col).withColumn("h", F.crc32(F.col("id").cast("string")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.col("h") % 10 == 0
    docs = docs.withColumns({"n": F.when(chosen, F.size(words)).cast("bigint"), "g": F.floor(F.col("h") / 10)})
    a = F.col("g") % F.nullif("n", F.lit(0))
    docs = docs.withColumn("a", a).withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)

    def n(c: Column) -> Column:
        return c.cast("int")

    left = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice(words, n(F.col("a") + 1), n(F.col("p"))), n(F.ceil(left / F.col("p")))))
    rebuilt = F.array_join(F.concat(F.slice(words, F.lit(1), n(F.col("a"))), F.slice(again, F.lit(1), n(left))), " ")
    return docs.select("id", F.when(chosen & (F.col("n") > 0), rebuilt).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The query's form of ``find_runs``: the run of the greatest exponent and checksums of all runs and of the text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
