"""Near copies among embedding vectors: links of cosine ``SIMILARITY`` or more within a label.

Method: one flat graph over all vectors, built in overlapping shards.

* Equal vectors of a label are one node with a number of copies.
* Nodes go to the ``OVERLAP`` nearest of their label's cluster centres (k-means on a bounded sample;
  the centres, ``MAX_CELLS`` at most, are sent to all tasks). A cell is a shard.
* Each shard proposes neighbours for its nodes, the nearest ones and a few drawn by hash, and keeps
  those that robust pruning leaves; the lists of a node from all its shards are united.
* Every node is searched for in its shards: greedily from the shard's medoids over the united lists,
  then by expanding everything found in range, until nothing new is in range.
* Candidates are verified in double precision. ``audit`` measures recall against brute force.

A shard above ``SHARD_LIMIT`` nodes (a dense group of near copies, or more vectors than the centres
can part) is compared exactly instead, block by block: no group has to fit one task. Shards return
neighbour lists and local component roots, so rows stay proportional to vectors, not to links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.columns import picked
from millrace.llm.components import components
from millrace.llm.text import mixed
from millrace.session import materialise

SIMILARITY = 0.98
OVERLAP = 2
CELL_ROWS = 512
MAX_CELLS = 16_384
SHARD_LIMIT = 4096
BLOCK_ROWS = 2048
SAMPLE_ROWS = 64        # rows of the clustering sample per cell
NEAREST, DRAWN, DEGREE, BACK, STRETCH = 40, 6, 24, 4, 1.2
BEAM, MEDOIDS = 24, 4
QUERIES_AT_ONCE = 64    # a dense group has many nodes to expand for each
SLACK = 1e-4            # single precision while searching
RADIUS = 0.05           # nodes a little out of range are expanded too: the way to one in range may lead over them

NODES = "node bigint, label string, x array<double>, copies bigint"
LINKED = "node bigint, near array<struct<node: bigint, copies: bigint>>, root bigint"


def _valid(x: str = "x"):
    """Not null, all components finite, not all zero."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Vectors of one length as unit rows; scaled first, so that squares neither vanish nor overflow."""
    x = np.stack(list(vectors)).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ------------------------------------------------------------------ clusters


def centres_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means centres of unit vectors; starts are spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _assigned(centres: dict[str, tuple[int, np.ndarray]], overlap: int):
    """Each node once for each of its cells; a label's cells are numbered from its first on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), object)
            vectors = batch.column(2).to_numpy(zero_copy_only=False)
            row, cell = [], []
            for name in sorted(set(label)):
                first, c = centres[name]
                at = np.flatnonzero(label == name)
                near = np.argsort(-(unit_rows(vectors[at]).astype(np.float32) @ c.T), axis=1, kind="stable")[:, :overlap]
                row.append(np.repeat(at, near.shape[1]))
                cell.append(near.ravel() + first)
            if row:
                row, cell = np.concatenate(row), np.concatenate(cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *(batch.column(k).take(pa.array(row)) for k in (0, 2, 3))], names=["cell", "node", "x", "copies"])
    return run


def _cells(nodes: DataFrame, cell_rows: int, max_cells: int, overlap: int) -> DataFrame:
    """``(cell, node, x, copies)``."""
    sizes = dict(sorted((r["label"], r["n"]) for r in nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_cells + 1).collect()))
    if len(sizes) > max_cells:
        # More labels than centres: each label is a cell of its own.
        return nodes.select(F.xxhash64("label").alias("cell"), "node", "x", "copies")
    rows = max(cell_rows, -(-sum(sizes.values()) // max(1, max_cells - len(sizes))))
    k = {name: -(-n // rows) for name, n in sizes.items()}
    share = F.pmod(F.xxhash64("node", F.lit("centres")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked_rows = nodes.filter(share < F.lit(SAMPLE_ROWS / rows)).select("label", "x").toPandas()       # about SAMPLE_ROWS rows per centre
    centres, first = {}, 0
    for name in sizes:
        x = picked_rows.loc[picked_rows["label"] == name, "x"]
        # A label of which nothing was drawn is one cell; its key begins with the length of its vectors.
        c = centres_of(unit_rows(x), k[name]).astype(np.float32) if len(x) else np.zeros((1, int(name.split(":", 1)[0])), np.float32)
        centres[name], first = (first, c), first + len(c)
    return nodes.mapInArrow(_assigned(centres, overlap), "cell bigint, node bigint, x array<double>, copies bigint")


# ------------------------------------------------------------------ the graph of a shard


def neighbour_lists(x: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Robustly pruned neighbours of each unit vector: nearest first, dropping what a kept one is ``STRETCH`` times nearer to."""
    n = len(x)
    nearest = min(NEAREST, n - 1)
    out: list[np.ndarray] = []
    for a in range(0, n, 512):
        sims = x[a:a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        best = np.argpartition(-sims, nearest - 1, axis=1)[:, :nearest] if nearest else np.zeros((len(sims), 0), int)
        for i, near in enumerate(best, a):
            drawn = (mixed(nodes[i:i + 1].astype(np.uint64) + np.arange(1, DRAWN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
            pool = np.unique(np.concatenate((near, drawn[drawn != i])))
            d = 1 - x[pool] @ x[i]
            pool = pool[np.argsort(d, kind="stable")]
            d = np.sort(d, kind="stable")
            between = 1 - x[pool] @ x[pool].T
            alive, kept = np.ones(len(pool), bool), []
            for j in range(len(pool)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == DEGREE:
                        break
                    alive &= STRETCH * between[j] > d
            out.append(pool[kept])
    return out


def _graph(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    nodes = frame["node"].to_numpy()
    lists = neighbour_lists(_unit(frame).astype(np.float32), nodes)
    back: list[list[int]] = [[] for _ in nodes]
    for i, near in enumerate(lists):        # every node can be reached from some of its neighbours, those with room first
        for j in sorted(near.tolist(), key=lambda j: len(back[j]) // 8)[:BACK]:
            back[j].append(i)
    return pd.DataFrame({"node": nodes, "near": [nodes[np.unique(np.concatenate((a, np.array(b, np.int64))))] for a, b in zip(lists, back)]})


def _unit(frame: pd.DataFrame) -> np.ndarray:
    return unit_rows(frame["x"])


# ------------------------------------------------------------------ search


def _greedy(x: np.ndarray, table: np.ndarray, queries: np.ndarray, starts: np.ndarray, seen: np.ndarray) -> None:
    """Best-first search of all queries in step; ``table`` pads neighbour lists with -1, ``seen[query, node]`` gets what was looked at."""
    q = np.arange(len(queries))
    pool = np.full((len(queries), BEAM), -1)
    sims = np.full((len(queries), BEAM), -2.0, np.float32)
    opened = np.ones((len(queries), BEAM), bool)
    k = min(len(starts), BEAM)
    pool[:, :k], sims[:, :k], opened[:, :k] = starts[:k], x[queries] @ x[starts[:k]].T, False
    seen[:, starts[:k]] = True
    for _ in range(200):
        best = np.where(opened, -3.0, sims).argmax(axis=1)
        active = ~opened[q, best]
        if not active.any():
            return
        rows = q[active]
        opened[rows, best[active]] = True
        near = table[pool[rows, best[active]]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        new = np.full(near.shape, -2.0, np.float32)
        new[r, c] = np.einsum("ij,ij->i", x[queries[rows[r]]], x[near[r, c]])
        all_sims, all_pool = np.concatenate((sims[rows], new), axis=1), np.concatenate((pool[rows], near), axis=1)
        all_open = np.concatenate((opened[rows], ~fresh), axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :BEAM]
        pool[rows], sims[rows], opened[rows] = (np.take_along_axis(v, order, axis=1) for v in (all_pool, all_sims, all_open))


def range_search(x: np.ndarray, lists: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) in range: greedy search from medoids, then expansion of all nodes in range."""
    n = len(x)
    table = np.full((n, max(1, max(map(len, lists)))), -1)
    for i, near in enumerate(lists):
        table[i, :len(near)] = near
    single = x.astype(np.float32)
    starts = np.unique((x @ centres_of(x, MEDOIDS, 3).T).argmax(axis=0))
    low = similarity - SLACK
    found_q, found_n = [], []
    for a in range(0, n, QUERIES_AT_ONCE):
        queries = np.arange(a, min(n, a + QUERIES_AT_ONCE))
        seen = np.zeros((len(queries), n), bool)
        _greedy(single, table, queries, starts, seen)
        seen[np.arange(len(queries)), queries] = True          # a query is a node of the graph as well
        q, node = np.nonzero(seen)
        while len(q):
            sims = np.einsum("ij,ij->i", single[queries[q]], single[node])
            found_q.append(queries[q[sims >= low]])
            found_n.append(node[sims >= low])
            q, node = q[sims >= low - RADIUS], node[sims >= low - RADIUS]
            pairs = np.repeat(q, table.shape[1]), table[node].ravel()
            keep = pairs[1] >= 0
            code = np.unique(pairs[0][keep] * np.int64(n) + pairs[1][keep])
            q, node = code // n, code % n
            new = ~seen[q, node]
            q, node = q[new], node[new]
            seen[q, node] = True
    q, node = np.concatenate(found_q), np.concatenate(found_n)
    return q[q != node], node[q != node]


def _cosines(frame: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision, from the vectors as they are."""
    x = np.stack(frame["x"].to_list()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)               # so that squares neither vanish nor overflow
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = np.zeros(len(a))
    for k in range(0, len(a), 1 << 16):
        s = slice(k, k + (1 << 16))
        out[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) / (norms[a[s]] * norms[b[s]])
    return out


def _linked(frame: pd.DataFrame, a: np.ndarray, b: np.ndarray, similarity: float) -> pa.Table:
    """Verified neighbours of every node that has any, and the smallest node it is connected to in this shard."""
    ok = _cosines(frame, a, b) >= similarity
    a, b = np.concatenate((a[ok], b[ok])), np.concatenate((b[ok], a[ok]))
    code = np.unique(a * np.int64(len(frame)) + b)
    a, b = code // len(frame), code % len(frame)
    nodes, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
    root = np.arange(len(frame))                                # frame is sorted by node
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        least = least[least]
        if (least == root).all():
            break
        root = least
    own, heads = np.unique(a, return_index=True)
    near = pa.ListArray.from_arrays(pa.array(np.append(heads, len(b)), pa.int32()), pa.StructArray.from_arrays([pa.array(nodes[b], pa.int64()), pa.array(copies[b], pa.int64())], names=["node", "copies"]))
    return pa.table({"node": pa.array(nodes[own], pa.int64()), "near": near, "root": pa.array(nodes[root[own]], pa.int64())})


def _searched(similarity: float):
    def run(shard: pa.Table) -> pa.Table:
        frame = shard.to_pandas().sort_values("node").reset_index(drop=True)
        nodes = frame["node"].to_numpy()
        lists = []
        for near in frame["lists"]:
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(nodes, near), len(nodes) - 1)
            lists.append(at[nodes[at] == near])
        return _linked(frame, *range_search(_unit(frame), lists, similarity), similarity)
    return run


def _compared(similarity: float):
    """All pairs of one or two blocks of a large shard."""
    def run(shard: pa.Table) -> pa.Table:
        frame = shard.to_pandas().sort_values("node").reset_index(drop=True)
        unit, left = _unit(frame), np.flatnonzero(frame["side"].to_numpy() <= 0)
        right = np.flatnonzero(frame["side"].to_numpy() >= 0)
        a, b = [], []
        for k in range(0, len(left), 512):
            i, j = np.nonzero(unit[left[k:k + 512]] @ unit[right].T >= similarity - SLACK)
            a.append(left[k + i])
            b.append(right[j])
        a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        return _linked(frame, a[a != b], b[a != b], similarity)
    return run


# ------------------------------------------------------------------ the operator


def _links(nodes: DataFrame, similarity: float, cell_rows: int, shard_limit: int, block_rows: int, max_cells: int, overlap: int) -> DataFrame:
    members = materialise(_cells(nodes, cell_rows, max_cells, overlap), "embeddings-members")
    sizes = members.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialise(members.join(materialise(sizes, "embeddings-sizes"), "cell"), "embeddings-shards")
    small, large = members.filter(F.col("size") <= shard_limit), members.filter(F.col("size") > shard_limit)
    graph = small.groupBy("cell").applyInPandas(_graph, "node bigint, near array<bigint>")
    graph = materialise(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("lists")), "embeddings-graph")
    found = small.join(graph, "node").groupBy("cell").applyInArrow(_searched(similarity), LINKED)
    # Blocks i <= j of a large shard meet in the group (cell, i, j); side -1 is block i, 1 block j, 0 both.
    blocks = F.ceil(F.col("size") / F.lit(block_rows))
    cut = large.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("node"), blocks))
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("a"), F.greatest("i", j).alias("b"), F.when(F.col("i") == j, 0).when(F.col("i") < j, -1).otherwise(1).alias("side")))
    cut = cut.select("cell", "node", "x", "copies", F.explode(meets).alias("m")).select("cell", "node", "x", "copies", "m.*")
    return found.union(cut.groupBy("cell", "a", "b").applyInArrow(_compared(similarity), LINKED))


def near_copies(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS, shard_limit: int = SHARD_LIMIT, block_rows: int = BLOCK_ROWS, max_cells: int = MAX_CELLS, overlap: int = OVERLAP) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row.

    Vectors that are null, zero, hold null or non-finite components or have no label link with
    nothing; so do vectors of different lengths. Rows that repeat an id are one vector if they agree,
    and else separate ones, each with its own links. A row with a null id links with nothing, has
    a null component and is kept. An empty table gives an empty one; other columns are not read.
    """
    rows = picked(df, id=id_col, label=label_col, x=vector_col).select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("x").cast("array<double>").alias("x"))
    rows = rows.withColumn("label", F.when(_valid() & F.col("id").isNotNull(), F.concat_ws(":", F.size("x"), "label")))
    rows = rows.withColumns({"h1": F.xxhash64("label", "x"), "h2": F.xxhash64("x", "label", F.lit("again"))})
    keys = materialise(rows.select("id", "label", "h1", "h2"), "embeddings-keys")
    valid = rows.filter("label IS NOT NULL")
    # The copies of a vector are counted on its hashes; only one of them carries it on, under its own hash: an id may have several vectors.
    copies = keys.filter("label IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count_distinct("id").alias("copies"))
    copies = materialise(copies.withColumn("node", F.col("h1")), "embeddings-copies")
    nodes = valid.join(copies, ["h1", "h2"]).filter("id = first").select("node", "label", "x", "copies").dropDuplicates(["node"])
    nodes = materialise(nodes, "embeddings-nodes")
    links = materialise(_links(nodes, similarity, cell_rows, shard_limit, block_rows, max_cells, overlap), "embeddings-links")
    counts = links.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).select("node", F.aggregate("near", F.lit(0).cast("bigint"), lambda s, v: s + v["copies"]).alias("others"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "embeddings-groups")
    members = materialise(copies.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).select("node", "first", "group"), "embeddings-members-of-groups")
    least = materialise(members.groupBy("group").agg(F.min("first").alias("component")), "embeddings-least")
    members = members.join(least, "group").select("node", "component")
    known = copies.join(counts, "node", "left").join(members, "node").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    known = materialise(known, "embeddings-known")
    out = keys.join(known, ["h1", "h2"], "left")
    component = F.when(F.col("label").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select("id", F.when(F.col("label").isNotNull(), F.col("n_links")).otherwise(F.lit(0)).alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    """The query's form."""
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


# ------------------------------------------------------------------ audit


def _counted(labels: list, ids: list, queries: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(ids), np.int64)
        kinds = np.array(labels, object)
        for batch in batches:
            vectors = batch.column(2).to_numpy(zero_copy_only=False)
            own = np.array(batch.column(1).to_pylist(), object)
            for name in set(own) & set(labels):
                a, b = np.flatnonzero(kinds == name), np.flatnonzero(own == name)
                hits = (unit_rows(queries[a]) @ unit_rows(vectors[b]).T >= similarity) & (np.array(ids)[a][:, None] != np.asarray(batch.column(0))[b])
                counts[a] += hits.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts)], names=["id", "n"])
    return run


def audit(df: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, similarity: float = SIMILARITY, every: int = 100, block: int = 10_000) -> float:
    """Share of the links of every ``every``-th id, by brute force against all rows, that ``found`` counts. Queries are sent out ``block`` at a time."""
    rows = picked(df, id=id_col, label=label_col, x=vector_col).select(F.col("id").cast("bigint").alias("id"), F.concat_ws(":", F.size("x"), F.col("label").cast("string")).alias("key"), F.col("label").alias("label"), F.col("x").cast("array<double>").alias("x"))
    rows = rows.filter(_valid()).select("id", F.col("key").alias("label"), "x")
    queries = rows.filter(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // block))
    true = hit = 0
    for k in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toPandas()
        if not len(some):
            continue
        counts = rows.mapInArrow(_counted(some["label"].tolist(), some["id"].tolist(), some["x"].to_numpy(), similarity), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
        both = counts.join(found.select("id", "n_links"), "id").agg(F.sum("n").alias("true"), F.sum(F.least("n", "n_links")).alias("hit")).first()
        true, hit = true + (both["true"] or 0), hit + (both["hit"] or 0)
    return hit / true if true else 1.0
