"""Embedding near-dedup and connected components."""

import random

import numpy as np
import pytest

from millrace.llm import embeddings
from millrace.llm.components import components


def by_force(rows):
    """rows: (id, vector, label) with distinct ids; (id, links, component)."""
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = {r[0]: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in ok}
    label = {r[0]: r[2] for r in ok}
    near = {i: [j for j in x if j != i and label[i] == label[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.98] for i in x}
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (i, len(near.get(i, ())), min(seen), min(seen) == i)
    return out


def clustered(seed, groups=25, size=12, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=width)
        for k in range(size):
            v = centre + rng.normal(size=width) * (0.0 if k < 3 else 0.12)
            rows.append((len(rows), v.astype(np.float32).tolist(), g % 3 if k % 5 else 0))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("options", [{}, {"cell_rows": 40}, {"shard_limit": 20, "block_rows": 8}, {"max_cells": 2}])
def test_links_against_brute_force(spark, options):
    rows = clustered(1)
    df = spark.createDataFrame(rows, SCHEMA)
    found = embeddings.near_copies(df, **options)
    got = {r["vec_id"]: tuple(r) for r in embeddings.digest(found).collect()}
    want = by_force(rows)
    assert len(got) == len(rows)
    links = sum(w[1] for w in want.values())
    assert all(got[i][1] <= want[i][1] for i in want) and sum(g[1] for g in got.values()) >= 0.97 * links
    if "cell_rows" not in options:
        assert got == want


def planted(seed, vectors=6000, width=48):
    """Near copies in groups of two to forty, with angles on both sides of the limit, among vectors of their own."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < vectors:
        centre = rng.normal(size=width)
        size = int(rng.choice([1, 1, 1, 2, 3, 8, 40]))
        for _ in range(size):
            v = centre + rng.normal(size=width) * (rng.uniform(0.02, 0.2) if size > 1 else 0)
            rows.append((len(rows), v.astype(np.float32).tolist(), int(size > 2)))
    order = rng.permutation(len(rows))
    return [(int(order[i]), x, label) for i, x, label in rows]


def test_recall_of_planted_links(spark):
    """Enough vectors for several cells; the links of every hundredth row by ``audit``, and all of them here."""
    rows = planted(4)
    df = spark.createDataFrame(rows, SCHEMA)
    found = embeddings.near_copies(df, cell_rows=400, shard_limit=2000)
    got = {r["id"]: r["n_links"] for r in found.collect()}
    ids, true = np.array([r[0] for r in rows]), {}
    for label in (0, 1):
        at = np.array([r[2] == label for r in rows])
        x = np.array([r[1] for r in rows])[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        true |= dict(zip(ids[at].tolist(), ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist()))
    total = sum(true.values())
    assert total > 5000 and all(got[i] <= true[i] for i in true)
    assert sum(got.values()) >= 0.97 * total
    assert embeddings.audit(df, found) >= 0.9


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 1), (3, [0.0, 0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in embeddings.digest(embeddings.near_copies(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 1, 1, False)]


def test_vectors_awkward(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 2.0], 1), (4, [float("nan"), 1.0, 1.0], 1), (5, [float("inf"), 1.0, 1.0], 1), (6, v, None), (7, v, 1), (8, [2.0, 4.0, 6.0], 1), (9, v, 2), (10, v, 1), (11, [1.0, 2.0], 1), (12, [], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'y' AS node", "'z' AS component", "1 AS near", "'w' AS `a.b`")
    got = {r["vec_id"]: tuple(r) for r in embeddings.digest(embeddings.near_copies(df)).collect()}
    assert got == by_force(rows)
    assert got[14] == (14, 4, 7, False)
    twice = embeddings.near_copies(df.union(df.filter("vec_id = 7")).union(df.filter("vec_id = 8").selectExpr("CAST(NULL AS bigint) AS vec_id", *[f"`{c}`" for c in df.columns[1:]])))
    found = sorted((r["id"] or -1, r["n_links"]) for r in twice.collect())
    assert found.count((7, 4)) == 2 and (-1, 0) in found
    assert embeddings.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(400, 500)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (7, None), edges[0]], "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == {(x, find(x)) for x in parent}
    assert components(df.limit(0)).count() == 0
