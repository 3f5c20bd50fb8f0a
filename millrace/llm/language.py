"""Language of whole texts from unigrams marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a
word is the sum over all its segmentations of the product of piece probabilities, by the forward
algorithm; a text's is the product over its words. All words of a batch run in step, as arrays; words of
more than ``WORD_CHARS`` code points in slices, in logarithms, with the sums of the positions that pieces
across a cut reach carried over it.

Probabilities come from expectation maximisation over the words of a bounded sample of the labelled
rows (``train_rows`` per language, by hash of the id; documented parameter): forward and backward
sums give each piece's expected count. Only there are words cut after ``WORD_CHARS`` code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from millrace.llm.columns import col, picked
from millrace.llm.text import pieces as text_pieces
from millrace.llm.vocabulary import MARK, Vocabulary, model_path
from millrace.session import materialise

TRAIN_ROWS = 2000
ROUNDS = 2
WORD_CHARS = 32
SLICE_CHARS = 256
UNKNOWN = 1e-7
SMOOTHING = 0.1
NO_LANGUAGE = "und"
LEAST_SCORE = 0.5
LETTER = re.compile(r"[^\W\d_]")
PIECE_BYTES = 2 << 20
WORDS_AT_ONCE, SLICES_AT_ONCE = 6000, 500     # bound the memory of a lattice


class Trie:
    """Pieces as a sorted array of (node, character) keys, for lookups of many starts at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        nodes, children, piece = {"": 0}, {}, [-1]
        self.ids = []
        self.longest = max(map(len, vocabulary.pieces), default=1)
        for text in vocabulary.pieces:
            for k in range(1, len(text) + 1):
                if text[:k] not in nodes:
                    nodes[text[:k]] = len(piece)
                    children[nodes[text[:k - 1]] << 21 | ord(text[k - 1])] = len(piece)
                    piece.append(-1)
            piece[nodes[text]] = len(self.ids)
            self.ids.append(text)
        self.keys = np.array(sorted(children), np.int64)
        self.to = np.array([children[k] for k in self.keys.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)
        self.single = {c: k for k, c in enumerate(self.ids) if len(c) == 1}

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        want = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)


@dataclass
class Lattice:
    """All piece occurrences in a list of words: where they start and end, and the piece (-1: unknown character)."""

    starts: np.ndarray      # positions of words: word w has positions starts[w] .. starts[w] + length
    lengths: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    depth: np.ndarray       # characters of the word before the end of the piece

    @classmethod
    def of(cls, words: list[str], trie: Trie) -> Lattice:
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(ends, lengths) - np.arange(len(chars))         # characters to the end of the word
        position = np.arange(len(chars)) + word                         # one more position than characters in a word
        inside = lengths[word] - left
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        single = np.zeros(len(chars), bool)
        for k in range(trie.longest):
            keep = left[at] > k
            at, node = at[keep], node[keep]
            if not len(at):
                break
            node = trie.step(node, chars[at + k])
            at, node = at[node >= 0], node[node >= 0]
            piece = trie.piece[node]
            hit = piece >= 0
            found.append((at[hit], piece[hit], k + 1))
            if k == 0:
                single[at[hit]] = True
        lone = np.flatnonzero(~single)
        found.append((lone, np.full(len(lone), -1), 1))
        begin = np.concatenate([a for a, _, _ in found])
        size = np.concatenate([np.full(len(a), n) for a, _, n in found])
        depth = inside[begin] + size
        order = np.argsort(depth * (len(chars) + len(words) + 1) + position[begin] + size, kind="stable")
        begin, size = begin[order], size[order]
        return cls(ends - lengths + np.arange(len(words)), lengths, position[begin], position[begin] + size, np.concatenate([p for _, p, _ in found])[order], depth[order])

    def _levels(self) -> Iterator[slice]:
        cuts = np.searchsorted(self.depth, np.arange(1, self.depth.max(initial=0) + 2))
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over segmentations up to each position; p[piece, language], its last row for unknown characters."""
        total = np.zeros((int(self.starts[-1] + self.lengths[-1]) + 1 if len(self.starts) else 0, p.shape[1]))
        total[self.starts] = 1
        for level in self._levels():
            target = self.target[level]
            heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            total[target[heads]] = np.add.reduceat(total[self.source[level]] * p[self.piece[level]], heads, axis=0)
        return total

    def carry(self, logs: np.ndarray, before: np.ndarray, size: int) -> np.ndarray:
        """Logarithms of the forward sums, from those ``before[word, position]`` that earlier slices have reached; pieces start at the first ``size`` positions."""
        total = np.full((int(self.starts[-1] + self.lengths[-1]) + 1, logs.shape[1]), -np.inf)
        for k in range(before.shape[1]):
            there = self.lengths >= k
            total[self.starts[there] + k] = before[there, k]
        begins = self.source - self.starts[np.searchsorted(self.starts, self.source, "right") - 1] < size
        for level in self._levels():
            at = begins[level]
            target, source, piece = self.target[level][at], self.source[level][at], self.piece[level][at]
            if len(target):
                heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
                total[target[heads]] = np.logaddexp(total[target[heads]], np.logaddexp.reduceat(total[source] + logs[piece], heads, axis=0))
        return total

    def words(self, total: np.ndarray) -> np.ndarray:
        return total[self.starts + self.lengths]

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of every piece (and, last, of unknown characters) over words with weights[word, language]."""
        ahead = self.forward(p)
        behind = np.zeros_like(ahead)
        behind[self.starts + self.lengths] = weights / np.maximum(self.words(ahead), 1e-300)
        for level in reversed(list(self._levels())):
            np.add.at(behind, self.source[level], behind[self.target[level]] * p[self.piece[level]])
        flow = ahead[self.source] * p[self.piece] * behind[self.target]
        counts = np.zeros_like(p)
        np.add.at(counts, self.piece, flow)
        return counts


def marked(words: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Words with the mark in front, cut to runs of at most ``WORD_CHARS``; and the word of each run."""
    runs, owner = [], []
    for k, w in enumerate(words):
        w = MARK + w.decode()
        for a in range(0, len(w), WORD_CHARS):
            runs.append(w[a:a + WORD_CHARS])
            owner.append(k)
    return runs, np.array(owner, np.int64)


def _log_long(words: list[str], trie: Trie, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of marked words of any length."""
    out = np.empty((len(words), logs.shape[1]))
    active, start = np.arange(len(words)), 0
    before = np.full((len(words), trie.longest, logs.shape[1]), -np.inf)
    before[:, 0] = 0
    while len(active):
        lattice = Lattice.of([words[k][start:start + SLICE_CHARS + trie.longest - 1] for k in active], trie)
        total = lattice.carry(logs, before, SLICE_CHARS)
        ends = lattice.lengths <= SLICE_CHARS
        out[active[ends]] = lattice.words(total)[ends]
        at = lattice.starts[~ends, None] + SLICE_CHARS + np.arange(trie.longest)
        there = np.arange(trie.longest) + SLICE_CHARS <= lattice.lengths[~ends, None]
        before = np.where(there[:, :, None], total[np.minimum(at, len(total) - 1)], -np.inf)
        active, start = active[~ends], start + SLICE_CHARS
    return out


def _log_words(words: list[bytes], trie: Trie, p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations of each word."""
    texts = [MARK + w.decode() for w in words]
    size = np.array([len(t) for t in texts], np.int64)
    out = np.empty((len(texts), p.shape[1]))
    short, long = np.flatnonzero(size <= WORD_CHARS), np.flatnonzero(size > WORD_CHARS)
    for a in range(0, len(short), WORDS_AT_ONCE):
        at = short[a:a + WORDS_AT_ONCE]
        lattice = Lattice.of([texts[k] for k in at], trie)
        out[at] = np.log(np.maximum(lattice.words(lattice.forward(p)), 1e-300))
    logs = np.log(np.maximum(p, 1e-300)) if len(long) else p
    for a in range(0, len(long), SLICES_AT_ONCE):
        at = long[a:a + SLICES_AT_ONCE]
        out[at] = _log_long([texts[k] for k in at], trie, logs)
    return out


@dataclass
class Model:
    languages: list[str]
    priors: np.ndarray
    p: np.ndarray               # [piece, language]; the last row is an unknown character
    path: str


def training_rows(df: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about ``rows`` rows ``(lang, text)`` per language, by hash of the id: the same rows on every run."""
    sizes = df.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(F.broadcast(sizes), "lang").filter(share < F.lit(float(rows)) / F.col("size")).select("lang", "text")


def _expectation(trie: Trie, p: np.ndarray, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros_like(p)
        for batch in batches:
            for a in range(0, batch.num_rows, WORDS_AT_ONCE):
                frame = batch.slice(a, WORDS_AT_ONCE).to_pandas()
                runs, owner = marked([w.encode() for w in frame["word"]])
                weights = np.zeros((len(frame), len(languages)))
                weights[np.arange(len(frame)), pd.Categorical(frame["lang"], languages).codes] = frame["n"]
                counts += Lattice.of(runs, trie).expected(p, weights[owner])
        piece, lang = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(counts[piece, lang])], names=["piece", "lang", "n"])
    return run


def fit(df: DataFrame, *, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Piece probabilities from ``df(id, lang, text)``; rows with a null language teach nothing. Languages are few and listed on the driver."""
    path = path or model_path()
    trie = Trie(Vocabulary.load(path))
    labelled = df.filter(F.col("lang").isNotNull())
    words = training_rows(labelled, train_rows).select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    words = materialise(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    sizes = dict(sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()))
    languages = list(sizes)
    p = np.full((len(trie.ids) + 1, max(1, len(languages))), 1 / (len(trie.ids) + 1))
    for _ in range(rounds if languages else 0):
        found = words.mapInArrow(_expectation(trie, p, languages), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()   # at most a row per piece and language
        counts = np.full(p.shape, SMOOTHING)
        counts[found["piece"], found["lang"]] += found["n"]
        counts[-1] = 0
        p = counts / counts.sum(axis=0)
        p[-1] = UNKNOWN
    return Model(languages, np.array([n / sum(sizes.values()) for n in sizes.values()]), p, path)


def judged(texts: list[bytes], trie: Trie, model: Model) -> tuple[list[str], np.ndarray]:
    """Likeliest language and its posterior for UTF-8 texts."""
    if not model.languages:
        return [NO_LANGUAGE] * len(texts), np.zeros(len(texts))
    number: dict[bytes, int] = {}
    index, sizes = [], []
    for t in texts:
        words = t.split()
        sizes.append(len(words))
        index += [number.setdefault(w, len(number)) for w in words]
    sums = np.zeros((len(texts), len(model.priors)))
    if index:
        logs = _log_words(list(number), trie, model.p)[np.array(index)]
        sizes = np.array(sizes)
        full = np.flatnonzero(sizes)
        sums[full] = np.add.reduceat(logs, (np.cumsum(sizes) - sizes)[full], axis=0)
    sums += np.log(np.maximum(model.priors, 1e-9))
    letter = np.array([LETTER.search(t.decode()) is not None for t in texts], bool)
    posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    named = [model.languages[k] if ok else NO_LANGUAGE for k, ok in zip(sums.argmax(axis=1).tolist(), letter.tolist())]
    return named, np.where(letter, posterior, 0.0)


def _rows(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    for a, b, offsets, data in text_pieces(column, PIECE_BYTES):
        raw = data.tobytes()
        yield a, b, [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(Vocabulary.load(model.path))
        for batch in batches:
            for a, b, texts in _rows(batch.column(1)):
                named, score = judged(texts, trie, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(named, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
    return run


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row: the likeliest language and its posterior.

    ``und`` with score 0 for null and empty texts, texts without a letter, and when no language was
    learned. Equal likelihoods go to the first language in sorted order. Repeated rows and null ids
    are judged like others; an empty table gives an empty one; other columns are not read.
    """
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    return docs.mapInArrow(_predicted(model), "id bigint, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text is a multiple of five. A null id is not held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model from the rows that are not held out."""
    rows = df.filter(~held_out(id_col)).select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    return fit(rows, **options)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The query's form: learn from the rows that are not held out, predict for all."""
    found = predict(df, learned(df, id_col, text_col, lang_col, **options), id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def accept(df: DataFrame, model: Model, text_col: str = "text", *, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose text has a language with a posterior of at least ``least``. Null texts and texts without a letter go."""
    @F.arrow_udf(BooleanType())
    def accepted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(Vocabulary.load(model.path))
        for texts in parts:
            ok = np.zeros(len(texts), bool)
            for a, b, rows in _rows(texts):
                named, score = judged(rows, trie, model)
                ok[a:b] = (np.array(named, object) != NO_LANGUAGE) & (score >= least)
            yield pa.array(ok)
    return df.filter(accepted(col(text_col)))
