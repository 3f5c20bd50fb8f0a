"""URL filter: rules by host and path, and for all other URLs a ratio of two character models.

Accepted and rejected URLs each have a variable-order Markov model of their bytes (host and path):
a context of up to ``ORDER`` bytes counts where it was seen ``CONTEXT_ROWS`` times, and each order
is smoothed by the one below (Witten-Bell). The log-likelihood difference per byte is compared with
a threshold calibrated on the labelled URLs that the models have not seen (a fifth, by hash).

URLs that a rule decides are the labels. All of them are counted, by the 64-bit hashes of contexts and
of contexts with their next byte. Contexts seen fewer than ``CONTEXT_ROWS`` times, which no score reads,
go with their bytes. What is left grows with the distinct contexts of the labelled URLs: 16 bytes for
each context byte, 24 for each context. Up to ``MODEL_BYTES`` it is sent around as sorted arrays; beyond,
the distinct URLs' contexts are joined to the tables of counts and summed, with the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import col
from millrace.llm.text import BYTE_BASE, BYTE_VALUES, pieces, run_hash, run_sums
from millrace.session import materialise

ALLOW, BLOCK = "allow", "block"
#: The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
CONTEXT_ROWS = 4
BIN = 0.05
BINS = 400          # on either side of zero; further scores share the last bin
CALIBRATION = 5
MODEL_BYTES = 128 << 20
HEAVY = 1 << 12     # keys with this share of all counts are few, and met by broadcast
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):       # the longest last, so it is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, say).otherwise(verdict)
    return text, verdict


def _padded(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with ``ORDER`` zero bytes before and one after: (first, last, bytes, positions to predict, their row)."""
    for a, b, offsets, data in pieces(column, 1 << 20):
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(b - a), sizes)
        out = np.zeros(len(data) + (b - a) * (ORDER + 1), np.uint8)
        out[np.arange(len(data)) + (row + 1) * ORDER + row] = data
        owner = np.repeat(np.arange(b - a), sizes + 1)
        yield a, b, out, np.arange(len(owner)) + (owner + 1) * ORDER, owner


def _keys(sums, at: np.ndarray, before: int, after: int) -> np.ndarray:
    return run_hash(sums, at - before, at + after).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (model, context, context and byte, n) of a task."""
    for batch in batches:
        rejected = np.asarray(batch.column(0)).astype(np.int64)
        for a, b, data, at, owner in _padded(batch.column(1)):
            sums = run_sums(BYTE_VALUES[data], BYTE_BASE)
            model = rejected[a:b][owner]
            for side in (0, 1):
                here = at[model == side]
                # The byte follows from the key of context and byte, so each of these has one context.
                gram, first, n = np.unique(np.concatenate([_keys(sums, here, k, 1) for k in range(ORDER + 1)]), return_index=True, return_counts=True)
                context = np.concatenate([_keys(sums, here, k, 0) for k in range(ORDER + 1)])[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), side, np.int32)), pa.array(context), pa.array(gram), pa.array(n.astype(np.int64))], names=["model", "context", "gram", "n"])


@dataclass
class Model:
    """Counts of both models: of contexts, of their different next bytes, of context and byte; the keys are sorted."""

    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]       # key, n, kinds
    grams: list[tuple[np.ndarray, np.ndarray]]                      # key, n
    filled: bool
    threshold: float = 0.0
    tables: tuple[DataFrame, DataFrame, int] | None = None         # contexts, grams and their sum instead of the arrays, where those would be too large

    def score(self, column: pa.Array) -> np.ndarray:
        """Log-likelihood difference per byte, accepted minus rejected; 0 where a model is empty."""
        out = np.zeros(len(column))
        if not self.filled:
            return out
        for a, b, data, at, owner in _padded(column):
            sums = run_sums(BYTE_VALUES[data], BYTE_BASE)
            p = np.full((2, len(at)), 1 / 256)
            for k in range(ORDER + 1):
                context, gram = _keys(sums, at, k, 0), _keys(sums, at, k, 1)
                for side in (0, 1):
                    keys, *counts = self.contexts[side]
                    n, kinds = _looked_up(keys, counts, context)
                    seen, = _looked_up(self.grams[side][0], self.grams[side][1:], gram)
                    p[side] = np.where(n >= CONTEXT_ROWS, (seen + kinds * p[side]) / np.maximum(n + kinds, 1), p[side])
            out[a:b] = np.bincount(owner, np.log(p[0]) - np.log(p[1]), b - a) / np.bincount(owner, minlength=b - a)
        return out


def _looked_up(keys: np.ndarray, counts: Sequence[np.ndarray], wanted: np.ndarray) -> list[np.ndarray]:
    """The counts of the wanted keys, zero for those that are not there."""
    if not len(keys):
        return [np.zeros(len(wanted), np.int64) for _ in counts]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return [np.where(there, x[at], 0) for x in counts]


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column(batch.schema.get_field_index("said"))))], names=[*batch.schema.names, "score"])
    return run


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (h1, h2, at, k, context, gram) for each position of a URL and order."""
    for batch in batches:
        for a, b, data, at, owner in _padded(batch.column(2)):
            sums = run_sums(BYTE_VALUES[data], BYTE_BASE)
            h1, h2 = (np.asarray(batch.column(i))[a:b][owner] for i in (0, 1))
            for k in range(ORDER + 1):
                order = pa.array(np.full(len(at), k, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(at.astype(np.int32)), order, pa.array(_keys(sums, at, k, 0)), pa.array(_keys(sums, at, k, 1))],
                                                 names=["h1", "h2", "at", "k", "context", "gram"])


def _met(rows: DataFrame, table: DataFrame, key: str, total: int, how: str) -> DataFrame:
    """``rows`` joined to counts. The sum of all counts bounds the number of keys with a ``HEAVY``-th of it: those
    go to all tasks, as their rows would meet in one otherwise; the others are shuffled."""
    heavy = F.greatest("n0", "n1") >= max(1.0, total / HEAVY)
    hot = F.broadcast(table.filter(heavy))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table.filter(~heavy), key, how))


def _joined_scores(df: DataFrame, model: Model) -> DataFrame:
    """The scores of ``Model.score`` by joins of the distinct URLs' contexts and grams to the tables of counts."""
    contexts, grams, total = model.tables
    urls = df.select("said").distinct().select(F.xxhash64("said").alias("h1"), F.xxhash64("said", F.lit("url")).alias("h2"), "said")
    rows = materialise(urls.mapInArrow(_lookups, "h1 bigint, h2 bigint, at int, k int, context bigint, gram bigint"), "urls-lookups")
    side = lambda i, name: F.coalesce(F.sum(F.when(F.col("model") == i, F.col(name))), F.lit(0))
    by_context = contexts.groupBy("context").agg(*[side(i, c).alias(f"{c}{i}") for i in (0, 1) for c in ("n", "kinds")])
    by_gram = grams.groupBy("gram").agg(*[side(i, "n").alias(f"n{i}") for i in (0, 1)])
    rows = materialise(_met(rows, by_context, "context", total, "inner").withColumnsRenamed({"n0": "all0", "n1": "all1"}), "urls-contexts-met")
    rows = _met(rows, by_gram, "gram", total, "left").fillna(0, ["n0", "n1"])
    seen = F.array_sort(F.collect_list(F.struct("k", "all0", "kinds0", "n0", "all1", "kinds1", "n1")))      # at most a row per order

    def grown(i: int):
        def step(p, x):
            n, kinds, m = x[f"all{i}"], x[f"kinds{i}"], x[f"n{i}"]
            return F.when(n >= CONTEXT_ROWS, (m + kinds * p) / (n + kinds)).otherwise(p)
        return F.aggregate("seen", F.lit(1 / 256), step)

    logs = rows.groupBy("h1", "h2", "at").agg(seen.alias("seen")).select("h1", "h2", (F.log(grown(0)) - F.log(grown(1))).alias("log"))
    sums = logs.groupBy("h1", "h2").agg(F.sum("log").alias("log"))
    scores = urls.join(sums, ["h1", "h2"], "left").select("said", F.coalesce(F.col("log") / (F.octet_length("said") + 1), F.lit(0.0)).alias("score"))
    return df.join(scores, "said").select(*df.columns, "score")


def _with_scores(df: DataFrame, model: Model) -> DataFrame:
    if model.tables:
        return _joined_scores(df, model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(_scored(model), f"{fields}, score double")


def _sorted(table: DataFrame, key: str, counts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each model its keys in order and their counts."""
    found, out = table.toArrow(), []
    for side in (0, 1):
        part = found.filter(pc.equal(found["model"], side))
        keys = part[key].to_numpy()
        order = np.argsort(keys)
        out.append((keys[order], *(part[c].to_numpy()[order] for c in counts)))
    return out


def fit(df: DataFrame, *, model_bytes: int = MODEL_BYTES) -> Model:
    """Models and threshold from ``df(said, verdict)``; rows with a null verdict teach nothing.

    Counts of up to ``model_bytes`` go to every task as arrays; larger ones stay tables, and URLs meet them by joins, with the same scores.
    """
    labelled = df.filter(F.col("verdict").isNotNull()).select((F.col("verdict") == BLOCK).cast("int").alias("rejected"), "said")
    aside = F.pmod(F.xxhash64("said"), F.lit(CALIBRATION)) == 0
    counts = labelled.filter(~aside).mapInArrow(_counted, "model int, context bigint, gram bigint, n bigint").groupBy("model", "context", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "urls-counts")
    contexts = materialise(counts.groupBy("model", "context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).filter(F.col("n") >= CONTEXT_ROWS), "urls-contexts")
    grams = materialise(counts.join(contexts.select("model", "context"), ["model", "context"], "left_semi").select("model", "gram", "n"), "urls-grams")
    filled = counts.select("model").distinct().count() == 2
    if not filled:
        model = Model([], [], False)
    elif 24 * contexts.count() + 16 * grams.count() <= model_bytes:
        model = Model(_sorted(contexts, "context", ["n", "kinds"]), _sorted(grams, "gram", ["n"]), filled)
    else:
        model = Model([], [], filled, tables=(contexts, grams, contexts.agg(F.sum("n")).first()[0] or 0))
    scores = _with_scores(labelled.filter(aside), model)
    bins = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).cast("int")
    seen = scores.groupBy("rejected", bins.alias("bin")).agg(F.count("*").alias("n")).collect()                          # at most 2 * (2 * BINS + 1) rows
    by = np.zeros((2, 2 * BINS + 1))
    for r in seen:
        by[r["rejected"], r["bin"] + BINS] = r["n"]
    if by.any(axis=1).all():
        share = by / by.sum(axis=1, keepdims=True)
        # Errors at the lower edge of each bin: accepted URLs below it and rejected ones at or above it.
        wrong = np.concatenate(([0], np.cumsum(share[0])))[:-1] + share[1][::-1].cumsum()[::-1]
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12) - BINS
        model.threshold = float(best[np.argmin(np.abs(best))] * BIN)
    return model


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, *, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for every row.

    Null URLs and those without ``://`` have an empty host and path, which no rule fits; their
    score, like that of any empty string, is judged by the threshold. Without labels of both kinds
    the score is 0 and the threshold too, which allows. Repeated rows and null ids are judged like
    others; an empty table gives an empty one; other columns are not read.
    """
    host, path = host_and_path(col(url_col))
    parts = df.select(col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.concat("host", "path").alias("said"))
    model = fit(parts, model_bytes=model_bytes)
    scored = _with_scores(parts, model)
    own = F.when(F.col("score") >= model.threshold, ALLOW).otherwise(BLOCK)
    return scored.select("id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")


def page_verdicts(df: DataFrame) -> DataFrame:
    """The query's form."""
    return judge(df).withColumnRenamed("id", "page_id")
