"""Mixing, periodic runs and the conversation trie against brute force, with awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import conversations, mixing, runs
from tests.llm.conftest import SF

TURNS = "conv_id bigint, turn bigint, role string, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ mixing


def targets_by_force(sizes, weights, budget, limit):
    """Share by weight; whoever is above the limit stops there, the rest is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, budget * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(limit * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("weights,budget,limit", [((5, 2, 1), 1.5, 2), ((1,), 0.3, 1), ((9, 1), 2.6, 3)])
def test_targets_and_taken_words(spark, documents, weights, budget, limit):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("src0")).when(F.col("doc_id") % 17 != 1, F.col("source")))
    got = mixing.mix(docs, weights=weights, budget=budget, max_repeats=limit).collect()
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(words_of(r["text"]))
    want = targets_by_force(size, weights, budget, limit)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["copies"] <= limit
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == docs.count() and sum(want.values()) == pytest.approx(budget * sum(size.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)


def test_mix_agrees_between_layouts_and_nests(spark, documents):
    run = lambda df, budget: {r["id"]: r["copies"] for r in mixing.mix(df, budget=budget).collect()}
    one = run(documents, 1.5)
    assert run(documents.repartition(7), 1.5) == one
    less = run(documents, 0.4)
    assert all(less[d] <= one[d] for d in one) and any(less[d] < one[d] for d in one)


def test_repeated_rows_share_a_place_but_not_a_number(spark):
    """A thousand equal rows: the threshold falls between them. A source of one large document: the nearer of all and nothing."""
    rows = [(7, "a b", "x")] * 1000 + [(8, "w " * 5000, "y"), (None, None, None), (None, "", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), budget=0.3).collect()
    want = targets_by_force({"x": 2000, "y": 5000, None: 0}, (5, 2, 1), 0.3, 2)
    x = [r["copies"] * r["size"] for r in got if r["source"] == "x"]
    assert abs(sum(x) - want["x"]) <= 1 and len(set(x)) == 2
    assert [r["copies"] for r in got if r["source"] == "y"] == [0] and sum(r["size"] for r in got if r["source"] is None) == 0


def test_mix_of_awkward_and_empty_tables(spark, awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and {r["source"] for r in got} == {None}
    total = sum(r["size"] for r in got)
    assert {r["target"] for r in got} == {1.5 * total} and {r["source_size"] for r in got} == {total}
    largest = max(r["size"] for r in got)
    assert abs(sum(r["copies"] * r["size"] for r in got) - 1.5 * total) <= largest / 2
    assert mixing.digest(mixing.mix(nothing)).count() == 0


# ------------------------------------------------------------------ runs


def runs_by_force(c):
    """All stretches of every period; of those with one extent or inside another, only the smallest period counts."""
    out = []
    for q in range(1, len(c) // 4 + 1):
        i = 0
        while i + q < len(c):
            s = i
            while i + q < len(c) and c[i] == c[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                out.append((s, i - s + q, q))
            i += 1
    inside = lambda r, o: o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1]
    return sorted((r for r in out if not any(inside(r, o) for o in out)), key=lambda r: (r[0], r[2]))


def planted_by_force(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest_by_force(doc_id, text):
    w = planted_by_force(doc_id, words_of(text))
    found = runs_by_force(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def sequences(count, seed):
    rnd = random.Random(seed)
    for _ in range(count):
        k = rnd.choice([1, 2, 2, 3, 6])
        c = [rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            unit, a = [rnd.randrange(k) for _ in range(rnd.randint(1, 7))], rnd.randint(0, len(c))
            c = c[:a] + (unit * 9)[:rnd.randint(4, 50)] + c[a:]
        yield c


def test_runs_of_sequences():
    for c in sequences(1500, 3):
        assert runs.runs_of(c) == runs_by_force(c), c


def test_zones_lose_no_run_and_add_none():
    many = [c for c in sequences(400, 5)]
    doc = np.repeat(np.arange(len(many)), [len(c) for c in many])
    begin = np.concatenate(([0], np.cumsum([len(c) for c in many])))
    flat = np.array([x for c in many for x in c], np.int64)
    got = [[] for _ in many]
    for a, b in runs.zones(flat, doc):
        d = doc[a]
        assert doc[b - 1] == d
        got[d] += [(s + int(a - begin[d]), n, q) for s, n, q in runs.runs_of(flat[a:b].tolist())]
    assert [sorted(r, key=lambda r: (r[0], r[2])) for r in got] == [runs_by_force(c) for c in many]


def test_long_and_extreme_sequences():
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    assert runs.runs_of([4] * 30_000) == [(0, 30_000, 1)]
    assert runs.runs_of(list(range(700)) * 5) == [(0, 3500, 700)] and runs.runs_of(b[:900]) == runs_by_force(b[:900])
    assert runs.runs_of([]) == [] and runs.runs_of([1] * 5) == [] and runs.runs_of([1] * 6) == [(0, 6, 1)]
    assert runs.runs_of([1, 2] * 3) == [] and runs.runs_of([1, 2] * 4) == [(0, 8, 2)]


def test_link_cut_paths_against_walking_up():
    rnd = random.Random(2)
    parent = [0, 0] + [rnd.randint(max(1, v - 6), v - 1) for v in range(2, 300)]
    tree, seen = runs.LinkCut(parent), [0] * 300
    for i in range(1, 1500):
        x, path = rnd.randint(1, 299), []
        v = x
        while v:
            path.append(v)
            v = parent[v]
        want, at = [], 0
        for v in path:                     # from below: the lowest node of every piece of one colour
            if seen[v] and seen[v] != at:
                want.append((seen[v], v))
            at = seen[v]
        assert tree.access(x, i) == want
        for v in path:
            seen[v] = i


def test_runs_query_against_brute_force(spark, documents):
    docs = documents.filter(F.length("text") < 4000)
    got = runs.digest(runs.find_runs(runs.with_planted_runs(docs), "id", "text"))
    want = [digest_by_force(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(got) == sorted(want, key=repr) and sum(w[1] for w in want) > 5


def test_runs_of_awkward_texts(spark, awkward, nothing):
    extra = [(20, "a " * 500), (30, "\t".join(["x", "y", "z"] * 7)), (None, "q q q q q q"), (41, "é é é é é é"), (42, "a a " * 6)]
    docs = awkward.select("doc_id", "text", "`a.b`", "n").union(spark.createDataFrame([(d, t, None, None) for d, t in extra], "doc_id bigint, text string, ab string, n string"))
    got = runs.find_runs(docs)
    want = Counter()
    for r in docs.collect():
        w = words_of(r["text"])
        if len(w) < 1000:
            f = runs_by_force(w)
            gone = {k for s, n, q in f for k in range(s + q, s + n)}
            want[(r["doc_id"], len(w), tuple(f), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    have = Counter((r["id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["text"]) for r in got.collect() if r["n_words"] < 1000)
    assert have == want and got.count() == docs.count()
    long = {r["id"]: r for r in got.filter("n_words > 100000").collect()}
    assert set(long) == {4, 5} and all(r["runs"][0]["period"] == 977 * 3 and len(r["text"].split()) < 10_000 for r in long.values())
    planted = {r["id"]: words_of(r["text"]) for r in runs.with_planted_runs(docs).collect() if r["id"] not in (None, 6)}
    assert all(planted[r["doc_id"]] == planted_by_force(r["doc_id"], words_of(r["text"])) for r in docs.collect() if r["doc_id"] not in (None, 6))
    for df in (nothing, runs.with_planted_runs(nothing).withColumnRenamed("id", "doc_id")):
        assert runs.digest(runs.find_runs(df)).count() == 0


# ------------------------------------------------------------------ trie


def trie_by_force(table):
    conv = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append((turn is not None, turn, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r[3], r[4]) for r in sorted(v, key=lambda r: (r[0], r[1] or 0, r[2]))] for c, v in conv.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]       # the sign of a remainder is that of c
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
            if d:
                below[tuple(new[c][:d - 1])].add(tuple(new[c][:d]))
        ends[tuple(new[c])].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[b] for b in below[node]) or 1
        saved[node] = sum(saved[b] for b in below[node]) + ((len(members[node]) - 1) * len(words_of(node[-1][1])) if node else 0)
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(below[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
                   for k, m in members.items()), key=repr)


def table_of_turns(seed, convs=90, longest=70):
    rnd, rows = random.Random(seed), []
    for c in range(convs):
        prefix = rnd.choice([0, 5, 40])
        rows += [(c, t, ["user", "assistant", None][t % 3] if t < prefix else "user", f"turn {t}" if t < prefix else f"word {rnd.randrange(2)} end") for t in range(rnd.randint(1, longest if c % 7 == 0 else 6))]
    return rows


@pytest.mark.parametrize("band", [3, 16])
def test_trie_against_brute_force(spark, band):
    rows = table_of_turns(band)
    got = conversations.digest(conversations.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5), band))
    assert rows_of(got) == trie_by_force(rows)


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(conversations.digest(conversations.conversation_trie(df))) == trie_by_force([tuple(r) for r in df.collect()])


def test_trie_of_awkward_turns(spark):
    rows = [(0, None, None, None), (0, None, "user", None), (0, 1, "", "a b"), (0, 1, "", "a b"), (0, 2, "user", "x " * 20_000), (None, 1, "user", "lost"), (-7, 1, "user", ""), (-7, 1, "user", ""), (41, 1, "a", "b:c"),
            (42, 1, "ab", ":c"), (43, 5, "user", "only"), (44, 5, "user", "only"), (60, 3, None, "only"), (10**12, 1, "user", "x")] + [(c, 0, "user", "same") for c in range(100, 160)]
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("clash") for n in ("conv", "k", "depth", "x", "last", "words", "a.b")})
    assert rows_of(conversations.digest(conversations.conversation_trie(df))) == trie_by_force(rows)
    assert conversations.digest(conversations.conversation_trie(df.limit(0))).count() == 0


def test_many_ends_of_one_node_are_hashed_in_pieces(spark, monkeypatch):
    rows = [(20 * c, 0, "user", "hello there") for c in range(700)]
    df = conversations.chains(conversations.rebuilt(conversations.turns(spark.createDataFrame(rows, TURNS))))
    want = hashlib.sha256(",".join(str(20 * c) for c in range(700)).encode()).hexdigest()
    assert [tuple(r)[3] for r in conversations.ends_hashes(df, piece_ids=16).collect()] == [want]


def test_subtree_sums_do_not_depend_on_the_band(spark):
    rows = table_of_turns(9, convs=30, longest=200)
    df = spark.createDataFrame(rows, TURNS)
    assert rows_of(conversations.conversation_trie(df, 2)) == rows_of(conversations.conversation_trie(df, 1000))
