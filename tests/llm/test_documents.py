"""Operators on document texts against brute force, and on awkward input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import backoff, decontaminate, huffman, language, pieces, repeats, simhash
from millrace.llm.text import pieces as text_pieces
from millrace.llm.text import word_hashes, word_spans
from millrace.llm.tokens import WordEncoder, tokenizer_path
from millrace.llm.vocabulary import MARK, Vocabulary, model_path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# ------------------------------------------------------------------ words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \t\n ▁", max_size=12)), max_size=8), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts, limit):
    found = []
    for _, _, offsets, data in text_pieces(pa.array(texts, pa.string()), limit):
        starts, ends, first = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        raw = data.tobytes()
        found += [[(raw[starts[k]:ends[k]].decode(), h[k]) for k in range(a, b)] for a, b in zip(first[:-1], first[1:])]
    assert [[w for w, _ in row] for row in found] == [words_of(t) for t in texts]
    by_word = collections.defaultdict(set)
    for row in found:
        for w, x in row:
            by_word[w].add(int(x))
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)


# ------------------------------------------------------------------ substring dedup


def kept_by_force(rows, window=50):
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i:i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = {x for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i:i + window])] < d for x in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_runs", [repeats.GROUP_RUNS, 1])
def test_repeats_against_brute_force(documents, group_runs):
    got = repeats.digest(repeats.drop_repeats(documents, group_runs=group_runs, bucket_runs=64))
    assert sorted(map(tuple, got.collect()), key=repr) == kept_by_force(rows_of(documents))


def test_repeats_of_small_windows(spark):
    rng = random.Random(3)
    rows = [(k // 2, " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group_runs in (1, 512):
        got = repeats.digest(repeats.drop_repeats(df, window=6, anchor=3, group_runs=group_runs, bucket_runs=16))
        assert sorted(map(tuple, got.collect()), key=repr) == kept_by_force(rows, 6)


def test_repeats_awkward(awkward, nothing):
    got = sorted(map(tuple, repeats.digest(repeats.drop_repeats(awkward)).collect()), key=repr)
    assert got == kept_by_force(rows_of(awkward))
    assert repeats.drop_repeats(nothing).count() == 0 and repeats.without_repeats(nothing).count() == 0
    kept = repeats.without_repeats(awkward)
    assert kept.columns == awkward.columns
    texts = sorted(rows_of(kept), key=repr)
    assert (7, "x y") in texts and (5, "more") in texts and (2, "") in texts and (1, None) in texts and len(texts) == awkward.count()


# ------------------------------------------------------------------ SimHash


def fingerprint_by_force(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash_against_brute_force(documents):
    prints = {d: fingerprint_by_force(t) for d, t in rows_of(documents)}
    groups = groups_by_force(prints)
    got = {tuple(r) for r in simhash.digest(simhash.near_copies(documents)).collect()}
    assert got == {(d, f"{p:016x}", groups[d]) for d, p in prints.items()}


@pytest.mark.parametrize("limit", [64, 2])
def test_links_connect_all_near_fingerprints(spark, limit):
    rng = random.Random(5)
    values = []
    for _ in range(12):
        values.append(rng.getrandbits(64))
        for _ in range(10):
            values.append(values[-1] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    prints = dict(enumerate(dict.fromkeys(values)))
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in prints.items()}
    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), limit).collect()
    back = {v: k for k, v in signed.items()}
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        assert (prints[back[a]] ^ prints[back[b]]).bit_count() <= 2
        x, y = find(back[a]), find(back[b])
        parent[max(x, y)] = min(x, y)
    assert {k: find(k) for k in prints} == groups_by_force(prints)


def test_simhash_awkward(awkward, nothing):
    got = simhash.near_copies(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component"] == 1
    assert by[None]["component"] is None and by[11]["component"] == 6
    assert simhash.near_copies(nothing).count() == 0
    kept = simhash.first_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids.count(6) == 2 and 2 not in ids and 11 not in ids and kept.filter("doc_id IS NULL").count() == 1


# ------------------------------------------------------------------ token files


def test_token_files_round_trip(documents):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    before, want = 0, []
    for d, t in sorted(rows_of(documents)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    assert sorted(map(tuple, huffman.token_digest(documents).collect())) == want


def test_token_files_in_many_blocks(documents, spark, tmp_path):
    path = str(tmp_path / "tokens")
    huffman.write_tokens(documents, path, block_ids=500, shard_ids=20_000)
    got = huffman.read_tokens(spark, path).orderBy("start").collect()
    encoder = WordEncoder(tokenizer_path())
    at = 0
    for (d, t), r in zip(sorted(rows_of(documents)), got, strict=True):
        ids = [*np.frombuffer(encoder.encode([(t or "").encode()])[0], "<u4").tolist(), 2]
        assert (r["id"], r["start"], r["n"], r["ids"]) == (d, at, len(ids), ids)
        at += len(ids)
    assert spark.read.parquet(f"{path}/shards").count() > 1


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    encoder = WordEncoder(tokenizer_path(), remembered=40)
    texts = ["Hello, World!! it's <|endoftext|>x 12ab ab12 Éte É.É ﬁ", "é e ́x İI ΑΣ Σ ß ẞ", "a b 　 c\x1cd\x85e", "The the THE. the; (the) the's 'tis don't", "日本 語。!?", "", " \n", "xÿÀ%% ###x $$ &&& a,,b"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encoder.encode([t.encode()])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.integers(4, 16))
@settings(max_examples=60, deadline=None)
def test_code_is_a_limited_prefix_code(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = np.flatnonzero(counts)
    assert (lengths[counts == 0] == 0).all()
    if len(used) > 1:
        assert lengths.max() <= max(limit, (len(used) - 1).bit_length())
        assert sum(2.0 ** -int(lengths[k]) for k in used) == 1.0
        if limit >= 16:      # no shorter than plain Huffman
            import heapq
            heap = counts[used].tolist()
            heapq.heapify(heap)
            cost = 0
            while len(heap) > 1:
                both = heapq.heappop(heap) + heapq.heappop(heap)
                cost += both
                heapq.heappush(heap, both)
            assert (counts * lengths).sum() == cost
    if len(used):
        ids = np.random.default_rng(0).choice(used, 700)
        book = huffman.Codebook(lengths)
        code, marks = huffman.write_bits(ids, book.codes(), lengths, 64)
        runs = np.minimum(64, len(ids) - np.arange(0, len(ids), 64))
        words = np.concatenate((np.frombuffer(code, ">u8").astype(np.uint64), np.zeros(2, np.uint64)))
        assert (huffman.read_bits(words, marks, runs, book.table(), book.limit) == ids).all()


def test_token_files_awkward(awkward, nothing):
    got = huffman.token_digest(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[None]["start"] == 0 and by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    assert huffman.token_digest(nothing).count() == 0


# ------------------------------------------------------------------ pieces


VOCABULARY = Vocabulary.load(model_path())


def segmented_by_force(word, segmenter):
    best = [(0.0, [])] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            p = word[i:j]
            if p in VOCABULARY.pieces and not (i and MARK in p):
                found = best[i][0] + VOCABULARY.pieces[p][1], best[i][1] + [VOCABULARY.pieces[p][0]]
            elif len(p) == 1:
                found = best[i][0] + segmenter.unknown, best[i][1] + [VOCABULARY.bytes[b] for b in (" " if i == 0 else p).encode()]
            else:
                continue
            if best[j] is None or found[0] > best[j][0]:
                best[j] = found
    return best[-1][1]


def test_pieces_against_brute_force(documents):
    segmenter, joiner = pieces.Segmenter(VOCABULARY, remembered=3000), pieces.Joiner(VOCABULARY)
    texts = [t for _, t in rows_of(documents.limit(25))] + ["a  b", "▁x ▁", "日本語 😀\n\tq", " ", "", "x ", "é́"]
    for t in texts:
        ids = np.frombuffer(segmenter.encode([t])[0], np.int32).tolist()
        assert ids == [i for w in ((MARK + t.replace(" ", " " + MARK)).split(" ") if t else []) for i in segmented_by_force(w, segmenter)]
        assert joiner.decode(ids).decode() == t


def test_pieces_round_trip(documents, awkward, nothing):
    assert pieces.round_trip(documents).filter("NOT round_trip").count() == 0
    got = pieces.round_trip(awkward).collect()
    assert len(got) == awkward.count() and all(r["round_trip"] for r in got)
    assert {r["doc_id"]: r["n_pieces"] for r in got}[1] == 0
    assert pieces.round_trip(nothing).count() == 0


# ------------------------------------------------------------------ language


TRIE = language.Trie(VOCABULARY)


def test_forward_sums_and_expected_counts_against_brute_force():
    p = np.random.default_rng(1).random((len(TRIE.ids) + 1, 2)) / 1000
    index = {t: i for i, t in enumerate(TRIE.ids)}

    def ways(w):
        if not w:
            yield []
        for k in range(1, min(TRIE.longest, len(w)) + 1):
            if w[:k] in index:
                yield from ([index[w[:k]], *rest] for rest in ways(w[k:]))
            elif k == 1:
                yield from ([-1, *rest] for rest in ways(w[1:]))
    words = ["▁the", "▁tionhea.", "▁日x", "▁É", "▁"]
    lattice = language.Lattice.of(words, TRIE)
    sums = [sum(np.prod(p[way], axis=0) for way in ways(w)) for w in words]
    assert np.allclose(lattice.words(lattice.forward(p)), sums, rtol=1e-10)
    weights = np.array([[1.0, 2], [3, 0], [1, 1], [2, 5], [1, 0]])
    want = np.zeros_like(p)
    for w, s, k in zip(words, sums, weights):
        for way in ways(w):
            for piece in way:
                want[piece] += np.prod(p[way], axis=0) / s * k
    assert np.allclose(lattice.expected(p, weights), want, rtol=1e-8)


def test_long_words_sum_over_the_cuts():
    """Words of any length against a sum position by position over the whole word."""
    rng = np.random.default_rng(2)
    p = rng.random((len(TRIE.ids) + 1, 3)) / 1000
    index = {t: i for i, t in enumerate(TRIE.ids)}
    near, full = language.WORD_CHARS, language.SLICE_CHARS
    sizes = [near - 1, near, near + 1, full - 1, full, full + 1, full + TRIE.longest - 2, full + TRIE.longest - 1, full + TRIE.longest, 2 * full - 1, 2 * full + 3, 1500]
    words = ["".join(rng.choice(list("thetionand.日é"), n)) for n in sizes] + ["a" * 700, "日" * 300, "the", ""]
    got = language._log_words([w.encode() for w in words], TRIE, p)
    for w, sums in zip(words, got):
        w = language.MARK + w
        logs = [np.zeros(3)]
        for end in range(1, len(w) + 1):
            pieces = [(a, index.get(w[a:end], -1)) for a in range(max(0, end - TRIE.longest), end) if w[a:end] in index or (end - a == 1)]
            logs.append(np.logaddexp.reduce([logs[a] + np.log(p[k]) for a, k in pieces], axis=0))
        assert np.allclose(sums, logs[-1], rtol=1e-9)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_awkward(awkward, nothing, documents):
    got = {r["doc_id"]: r for r in language.identify(awkward).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 8)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[10]["lang_pred"] == "en"
    assert language.identify(nothing).count() == 0
    unlearned = language.fit(nothing.selectExpr("doc_id AS id", "lang", "text"))
    assert {r["lang_pred"] for r in language.predict(documents, unlearned).collect()} == {"und"}
    kept = language.accept(awkward, language.learned(documents))
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, None, 9, 10, 11}
    assert language.accept(nothing, unlearned).count() == 0


# ------------------------------------------------------------------ decontamination


def distance_by_force(words, item):
    cost = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(cost[j - 1] + (x != w), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def folded(text):
    return words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_leaks_against_brute_force(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = set()
    parsed = [(r["item_id"], folded(r["text"])) for r in items.collect()]
    for d, t in rows_of(documents.limit(120)):
        w = folded(t)
        for i, x in parsed:
            if len(x) >= 5 and len(set(x) & set(w)) >= 0.5 * len(set(x)):
                n = distance_by_force(w, x)
                if n <= decontaminate.allowed_edits(len(x)):
                    want.add((d, i, n))
    got = {(r["id"], r["item"], r["distance"]) for r in decontaminate.find_leaks(documents.limit(120), items).collect()}
    assert want and got == want


def test_edited_items_are_found_and_others_left_alone(spark, documents):
    items = [(r["item_id"], folded(r["text"])) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng, vocabulary, made = random.Random(5), folded(rows_of(documents.limit(1))[0][1]), []
    for i, item in items:
        for _ in range(4):
            x = list(item)
            for _ in range(decontaminate.allowed_edits(len(item))):
                p = rng.randrange(len(x))
                x[p:p + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            made.append((len(made), i, " ".join(rng.choices(vocabulary, k=30) + x + rng.choices(vocabulary, k=30))))
    df = spark.createDataFrame([(k, t) for k, _, t in made], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 400):
        found = decontaminate.find_leaks(df, table, block_words=block).collect()
        want = {(k, i) for k, i, _ in made}
        got = {(r["id"], r["item"]) for r in found}
        assert len(got & want) >= 0.97 * len(want) and not got - want
        sizes = dict((i, len(x)) for i, x in items)
        assert all(r["distance"] <= decontaminate.allowed_edits(sizes[r["item"]]) for r in found)
    clean = decontaminate.drop_leaks(df.union(spark.createDataFrame([(-1, " ".join(vocabulary))], df.schema)), table, block_words=400)
    assert {r["doc_id"] for r in clean.collect()} <= {-1} | {k for k, i in want - got}


def test_leaks_awkward(spark, awkward, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, " ".join(f"SAME{k}" for k in range(20, 60))), (None, " ".join(f"same{k}" for k in range(20, 60)))], "item_id long, text string")
    got = {(r["id"], r["item"]) for r in decontaminate.find_leaks(awkward, items).collect()}
    assert got == {(d, i) for d in (6, 7, None, 11) for i in (4, None)}
    assert decontaminate.find_leaks(nothing, items).count() == 0 and decontaminate.find_leaks(awkward, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(awkward, items)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9, 10}
    assert decontaminate.best_run([1, 2, 3, 9, 5], [2, 3, 4, 5], 1) == (1, 1, 5)


# ------------------------------------------------------------------ backoff


@pytest.mark.parametrize("order, options", [(3, {}), (2, {"chunk_ids": 3000, "range_grams": 2000})])
def test_scores_against_brute_force(documents, order, options):
    encoder = WordEncoder(tokenizer_path())
    rows = [(d, np.frombuffer(encoder.encode([(t or "").encode()])[0], "<u4").tolist()) for d, t in rows_of(documents)]
    counts, total = collections.Counter(), sum(len(ids) for _, ids in rows)
    for _, ids in rows:
        counts.update(tuple(ids[i:i + k]) for k in range(1, order + 1) for i in range(len(ids) - k + 1))
    got = {r["id"]: r for r in backoff.score(documents, order=order, **options).collect()}
    assert len(got) == len(rows)
    for d, ids in rows:
        own = collections.Counter(tuple(ids[i:i + k]) for k in range(1, order + 1) for i in range(len(ids) - k + 1))
        want = 0.0
        for i in range(len(ids)):
            longest = min(order, i + 1)
            for k in range(longest, 0, -1):
                g = tuple(ids[i - k + 1:i + 1])
                n = counts[g] - own[g]
                if k == 1:
                    want += math.log10(max(n, 0.5) / max(total - len(ids), 1)) + (longest - 1) * math.log10(0.4)
                elif n > 0:
                    want += math.log10(n / (counts[g[:-1]] - own[g[:-1]])) + (longest - k) * math.log10(0.4)
                    break
        assert got[d]["n_tokens"] == len(ids) and got[d]["score"] == pytest.approx(want, rel=1e-9)


def test_scores_awkward(awkward, nothing):
    got = backoff.document_scores(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 0 and by[1]["score"] == 0 and by[1]["mean_score"] is None and by[6]["mean_score"] < 0
    assert backoff.document_scores(nothing).count() == 0


@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=50))
@settings(max_examples=40, deadline=None)
def test_packing(values):
    for ascending in (True, False):
        assert backoff.unpack(backoff.pack(np.array(values, np.uint64), ascending), ascending).tolist() == values
