"""Text to the ids of a public piece vocabulary and back, by shared-prefix Viterbi.

Every space starts a word, marked by U+2581 (a text begins with a mark as well). Pieces do not
cross words, so a text's best segmentation is that of its words, and each distinct word is
segmented once: the words of a batch that are new are sorted, which lays them out as a depth-first
walk of their trie. The walk keeps, for each depth, the best score, the piece that ends there and
the pieces under way; the next word goes on from the depth it shares with the last one.

The score of a segmentation is the sum of the model's piece scores; of equal ones the longer last
piece wins. Characters without a piece become the bytes of their UTF-8 form. A U+2581 of the text
itself does so too, so decoding returns every text exactly.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.llm.text import lists, pieces as text_pieces
from millrace.llm.vocabulary import MARK, Vocabulary, model_path

REMEMBERED = 200_000
BATCH_BYTES = 2 << 20        # the more text at once, the fewer new words in it


class Segmenter:
    """Viterbi over the pieces of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED) -> None:
        self.vocabulary, self.remembered = vocabulary, remembered
        self.unknown = min((s for _, s in vocabulary.pieces.values()), default=0.0) - 10
        self.head: dict = {}        # pieces that begin with the mark
        self.inner: dict = {}       # all others
        for piece, found in vocabulary.pieces.items():
            node = self.head if piece[0] == MARK else self.inner
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        self.words: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Segment new words; each begins with the mark."""
        inner, unknown, raw = self.inner, self.unknown, self.vocabulary.bytes
        score, back, under_way = [0.0], [(0, None)], [[]]
        last = ""
        for word in sorted(words):
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del score[depth + 1:], back[depth + 1:], under_way[depth + 1:]
            for j in range(depth, len(word)):
                c = word[j]
                best, via, ongoing = None, None, []
                for i, node in under_way[j]:
                    node = node.get(c)
                    if node is not None:
                        ongoing.append((i, node))
                        found = node.get("")
                        if found is not None and (best is None or score[i] + found[1] > best):
                            best, via = score[i] + found[1], (i, found[0])
                node = self.head.get(c) if j == 0 else None if c == MARK else inner.get(c)
                found = None
                if node is not None:
                    ongoing.append((j, node))
                    found = node.get("")
                    if found is not None and (best is None or score[j] + found[1] > best):
                        best, via = score[j] + found[1], (j, found[0])
                if found is None and (best is None or score[j] + unknown > best):
                    best, via = score[j] + unknown, (j, None)
                score.append(best)
                back.append(via)
                under_way.append(ongoing)
            ids, j = [], len(word)
            while j:
                i, piece = back[j]
                if piece is None:
                    c = " " if i == 0 else word[i]
                    ids.extend([raw[b] for b in reversed(c.encode())])
                else:
                    ids.append(piece)
                j = i
            self.words[word] = array("i", ids[::-1]).tobytes()
            last = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; an empty text has none."""
        split = [(MARK + t.replace(" ", " " + MARK)).split(" ") if t else [] for t in texts]
        new = {w for words in split for w in words} - self.words.keys()
        if len(self.words) + len(new) > self.remembered:
            self.words, new = {}, {w for words in split for w in words}
        self.learn(list(new))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


class Joiner:
    """Ids back to UTF-8."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.parts = [b""] * vocabulary.size
        for piece, (i, _) in vocabulary.pieces.items():
            self.parts[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.bytes):
            self.parts[i] = bytes([b])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))[1:]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(Vocabulary.load(path))
        for batch in batches:
            for a, b, offsets, data in text_pieces(batch.column(1), BATCH_BYTES):
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ids = segmenter.encode([t.decode() for t in texts])
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(flat, np.array([len(x) // 4 for x in ids]), pa.int32()), pa.array([zlib.crc32(t) for t in texts], pa.int64())], names=["id", "ids", "text_crc32"])
    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None) -> DataFrame:
    """``(id, ids, text_crc32)`` for every row. Null and empty texts have no ids; repeated rows and null ids stay as they are; other columns are not read."""
    docs = picked(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    return docs.mapInArrow(_encoded(model or model_path()), "id bigint, ids array<int>, text_crc32 bigint")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(Vocabulary.load(path))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column("ids")
                flat, cuts = ids.flatten().to_numpy(), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()]).tolist()
                texts = [joiner.decode(flat[x:y].tolist()).decode() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
    return run


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; null ids give an empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(model or model_path()), f"{fields}, decoded string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None) -> DataFrame:
    """The query's form: ids, their number, and whether decoding them gave the text back."""
    decoded = decode(encode(df, id_col, text_col, model=model), model=model)
    return decoded.select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("bigint").alias("n_pieces"), (F.crc32(F.encode("decoded", "UTF-8")) == F.col("text_crc32")).alias("round_trip"))
