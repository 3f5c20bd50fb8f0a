"""Ids of whole texts with a public word-level tokenizer, one library call for many new words.

Encoding is local to the runs between ASCII white space: the tokenizer's normaliser never acts
across it and its pre-tokeniser drops it. So each distinct word is encoded once and remembered.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa

from millrace.llm.text import mixed, pieces, ranges, word_hashes, word_spans

WORD_TOKENIZER = "word_bpe_49k.json"
REMEMBERED = 250_000        # entries of one generation; two are kept
BATCH_BYTES = 3 << 19        # the more text at once, the fewer new words in it
END_OF_WORD = "</w>"
#: Closing marks of words: they are a token run of their own, and so are the Latin letters before them.
MARKS = b".,;:!?%$#*&|"
IS_MARK = np.isin(np.arange(256), list(MARKS))
ASCII_LETTER = np.array([bytes([b]).isalpha() for b in range(256)])
#: Latin letters beyond ASCII, as far as they are C3 and one of these in UTF-8 (the two signs among them left out).
C3_LETTER = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
WHOLE = b"\0"        # in front of what goes to the library as it is


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts word by word through a bounded memory of words and of their letters.

    A full memory becomes the old generation; what is met again moves to the new one without the library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(END_OF_WORD)]] = True
        self.parts: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.remembered = remembered

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, keys: list[bytes]) -> None:
        """Runs of letters encode to one end-of-word token each, so many of them can share a call."""
        for a in range(0, len(keys), 512):
            some = keys[a:a + 512]
            ids = np.array(self.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.parts.update(zip(some, [raw[x:y] for x, y in zip(cuts, cuts[1:])]))
            else:
                self.parts.update(zip(some, self._whole([k.decode() for k in some])))

    def remember(self, keys: list[bytes]) -> list[bytes]:
        """Ids of distinct keys: runs of letters, or ``WHOLE`` and any text without white space."""
        new = [k for k in keys if k not in self.parts]
        if len(self.parts) + len(new) > self.remembered:
            self.old, self.parts, new = self.parts, {}, keys
        old = self.old
        self.parts.update((k, old[k]) for k in new if k in old)
        new = [k for k in new if k not in old]
        self._letters([k for k in new if k[:1] != WHOLE])
        whole = [k for k in new if k[:1] == WHOLE]
        self.parts.update(zip(whole, self._whole([k[1:].decode() for k in whole])))
        return list(map(self.parts.__getitem__, keys))

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece in one array, and where each row ends. Words that agree in a 64-bit hash count as one."""
        starts, ends, first = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        last = np.maximum.accumulate(np.where(IS_MARK[data], np.int64(-1), np.arange(len(data))).astype(np.int32 if len(data) < 1 << 31 else np.int64))
        core = np.maximum(last[ends - 1] + 1, starts)
        after = np.concatenate(([False], data[:-1] == 0xC3))
        odd = np.concatenate(([0], np.cumsum(~(ASCII_LETTER[data] | (data == 0xC3) | (after & C3_LETTER[data])), dtype=np.int32 if len(data) < 1 << 31 else np.int64)))
        plain = (odd[core] == odd[starts]) & (core > starts)
        core[~plain] = ends[~plain]
        # Letters count as lower case (the library lowers them), all else as it is.
        keys = np.where(plain, word_hashes(data, starts, core, folded=True), mixed(word_hashes(data, starts, core)))
        _, at, word = np.unique(keys, return_index=True, return_inverse=True)
        _, mark_at, mark = np.unique(word_hashes(data, core, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        low = raw.lower()
        cuts = zip(starts[at].tolist(), core[at].tolist(), plain[at].tolist())
        parts = self.remember([low[a:b] if p else WHOLE + raw[a:b] for a, b, p in cuts])
        parts += self.remember([WHOLE + raw[a:b] for a, b in zip(core[mark_at].tolist(), ends[mark_at].tolist())])
        each = np.stack([word, mark + len(at)], axis=1).ravel()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        sizes, begins = sizes[each], (np.cumsum(sizes) - sizes)[each]
        ids = np.frombuffer(b"".join(parts), "<u4")[ranges(begins, sizes)]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[2 * first[1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian 32-bit integers, one bytes object a text."""
        ids, ends = self.encode_rows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        return [x.tobytes() for x in np.split(ids, ends[:-1])]


def process_encoder(path: str) -> WordEncoder:
    """The worker process's encoder: what it remembers outlives a task. Functions arrive by value, so a module of its own holds it."""
    memory = sys.modules.setdefault("millrace_worker_memory", ModuleType("millrace_worker_memory"))
    if path not in memory.__dict__:
        memory.__dict__[path] = WordEncoder(path)
    return memory.__dict__[path]


def encoded(path: str):
    """Arrow batches (id, text) to (id, n, ids): the ids packed as little-endian 32-bit integers and compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, squeeze = process_encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, offsets, data in pieces(batch.column(1), BATCH_BYTES):
                ids, ends = encoder.encode_rows(data, offsets)
                packed = [squeeze.compress(_narrow(x)) for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(packed, pa.binary())], names=["id", "n", "ids"])
    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Low halves of all ids, then the high halves: the latter are mostly zero and cost nothing once compressed."""
    return ids.view("<u2").reshape(-1, 2).T.tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    import zstandard

    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u2").reshape(2, -1)
    return halves[0].astype(np.uint32) | (halves[1].astype(np.uint32) << np.uint32(16))
