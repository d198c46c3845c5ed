"""Approximate nearest neighbours by inner product: NN-descent builds the graph, greedy search answers.

Equal vectors are one node that remembers its smallest ids. Nodes live in blocks of about BLOCK: a tree of
random hyperplanes, fitted on at most SAMPLE vectors, puts near vectors into one block, and hashes split
blocks that are too large. A node's id names its block, so blocks exchange messages by Spark joins on the
block: packed arrays, one row for a pair of blocks. Lists of neighbours and vectors are tables of their own:
a round moves the lists, the few vectors that other blocks ask for, and what is found, not the whole state.
A round of NN-descent tells nodes who has them as a neighbour, asks for the vectors of sampled neighbours,
compares all neighbours of a node with one another (neighbours of neighbours), and sends what beats a node's
worst neighbour. Rounds end when few edges change. Every node is indexed. A query is a node: its search starts
at its own neighbours and expands the best nodes not yet expanded, hop by hop, until its FRONT best are all
expanded. Vectors of unequal length get one more component that makes their lengths equal (the query's is
zero), which turns inner product into nearness.

Cases: vectors null, zero, or with null or non-finite components take no part; a row without an id is a
candidate like any other, last among ties, but no query; missing components of shorter vectors are 0; repeated
rows are neighbours of one another.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, read
from amalgam.llm.planes import Tree, matrix, usable

K = 20
EVERY = 20
DEGREE = 40
SAMPLED = 50
ROUNDS = 12
SETTLED = 0.003
BLOCK = 2_048
SAMPLE = 20_000
#: A search ends by itself; this many hops, far more than it takes, bound it.
HOPS = 24
EXPAND = 40
#: A search keeps the POOL best nodes that it has seen, and ends when the FRONT best of them are expanded.
POOL = 160
FRONT = 140
REVERSE = 64
_PLACE = 1 << 20
_ROWS = "block long, kind int, payload binary, moved long"
_STATE, _MESSAGE, _LISTS, _VECTORS, _WORST = 0, 1, 2, 3, 4


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all rows are equally long."""
    more = np.sqrt(np.maximum(0, longest**2 - (x * x).sum(axis=1)))
    return np.column_stack([x, more]).astype(np.float32)


def _row(block, kind, payload, moved=0):
    return (int(block), kind, pickle.dumps(payload, protocol=5), int(moved))


def _step(rows: DataFrame, work) -> DataFrame:
    """Run work(block, {kind: [payload]}) on the rows of each block; it gives rows for any blocks."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        by = defaultdict(list)
        for kind, payload in zip(frame["kind"], frame["payload"]):
            by[kind].append(pickle.loads(payload))  # noqa: S301  our own arrays
        return pd.DataFrame(work(int(key[0]), by), columns=["block", "kind", "payload", "moved"])

    return rows.groupBy("block").applyInPandas(run, _ROWS)


def _by_block(ids: np.ndarray):
    """(block, positions) of ids, by their block."""
    blocks = ids // _PLACE
    order = np.argsort(blocks, kind="stable")
    edges = np.flatnonzero(np.diff(blocks[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(blocks[part[0]]), part


def _noise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fixed random order, so that ties fall on different nodes."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return x ^ (x >> np.uint64(29))


def best_each(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int, first: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k best distinct b of each a, in order of a and falling s; `first` marks what wins over its equals."""
    prefer = np.zeros(len(a), bool) if first is None else first
    order = np.lexsort((~prefer, b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]) if len(a) else np.zeros(0, bool)
    order = order[new]
    order = order[np.lexsort((_noise(a[order], b[order]), -s[order], a[order]))]
    start = np.searchsorted(a[order], a[order])
    return order[np.arange(len(order)) - start < k]


def _among(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) are among the pairs (c, d)."""
    known, both = np.unique(np.concatenate([b, d]), return_inverse=True)
    key = np.concatenate([a, c]) * max(1, len(known)) + both
    return np.isin(key[: len(a)], key[len(a) :])


def _tabled(n: int, k: int, a, b, s, old) -> dict[str, np.ndarray]:
    """Rows (a, b, s) sorted by a to matrices of n x k; `old` marks edges that were there before."""
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = {"ids": np.full((n, k), -1, np.int64), "sims": np.full((n, k), -np.inf, np.float32), "new": np.zeros((n, k), bool)}
    out["ids"][a, place], out["sims"][a, place], out["new"][a, place] = b, s, ~old
    return out


def _start(block: int, x: np.ndarray, blocks: np.ndarray, counts: np.ndarray, degree: int) -> dict[str, np.ndarray]:
    """Neighbours within the block, the last quarter of them random nodes of any block."""
    n, rng = len(x), np.random.default_rng(block)
    near = degree - degree // 4
    a, b, s = [], [], []
    for lo in range(0, n, 512):
        t = x[lo : lo + 512] @ x.T
        t[np.arange(len(t)), np.arange(lo, lo + len(t))] = -np.inf
        top = np.argpartition(-t, min(near, n - 1), axis=1)[:, :near] if n > 1 else np.zeros((len(t), 0), int)
        a.append(np.repeat(np.arange(lo, lo + len(t)), top.shape[1]))
        b.append(block * _PLACE + top.ravel())
        s.append(np.take_along_axis(t, top, axis=1).ravel())
    a.append(np.repeat(np.arange(n), degree // 4))
    which = rng.choice(len(blocks), size=n * (degree // 4), p=counts / counts.sum())
    b.append(blocks[which] * _PLACE + (rng.random(len(which)) * counts[which]).astype(np.int64))
    s.append(np.full(len(which), -np.inf))  # not yet compared: anything beats them
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    keep = (a + block * _PLACE != b) & (np.isfinite(s) | (np.arange(len(s)) >= len(s) - len(which)))
    a, b, s = a[keep], b[keep], s[keep]
    pick = best_each(a, b, s, degree)
    return _tabled(n, degree, a[pick], b[pick], s[pick], np.zeros(len(pick), bool))


def _told(block: int, state: dict, moved: int = 0) -> list:
    """The rows of a block's state: its lists, its worst similarities, and its edges seen from their other end.

    Of one sender a node is told at most SAMPLED edges, new ones first.
    """
    at, place = np.nonzero(state["ids"] >= 0)
    dst, new = state["ids"][at, place], state["new"][at, place]
    order = np.lexsort((_noise(dst, at), ~new, dst))
    order = order[np.arange(len(order)) - np.searchsorted(dst[order], dst[order]) < SAMPLED]
    dst, src, new = dst[order], block * _PLACE + at[order], new[order]
    rows = [_row(block, _STATE, state, moved), _row(block, _WORST, state["sims"][:, -1])]
    return rows + [_row(b, _MESSAGE, (dst[on] % _PLACE, src[on], new[on])) for b, on in _by_block(dst)]


def _lists(block: int, by: dict) -> list:
    """Each node's sampled neighbours, both ways; requests for their vectors."""
    if not by[_STATE]:
        return []
    state = by[_STATE][0]
    at, place = np.nonzero(state["ids"] >= 0)
    a = np.concatenate([at, *[m[0] for m in by[_MESSAGE]]])
    b = np.concatenate([state["ids"][at, place], *[m[1] for m in by[_MESSAGE]]])
    new = np.concatenate([state["new"][at, place], *[m[2] for m in by[_MESSAGE]]])
    order = np.lexsort((~new, b, a))
    order = order[np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])] if len(order) else order
    a, b, new = a[order], b[order], new[order]
    order = np.lexsort((_noise(b, a), ~new, a))
    a, b, new = a[order], b[order], new[order]
    group = a * 2 + ~new  # at most SAMPLED new and as many old
    keep = np.arange(len(a)) - np.searchsorted(group, group) < SAMPLED
    a, b, new = a[keep], b[keep], new[keep]
    live = np.isin(a, a[new])  # without a new neighbour there is nothing to compare
    a, b, new = a[live], b[live], new[live]
    wanted = np.unique(b)
    # a list names places in `wanted`, which are short numbers
    out = [_row(block, _LISTS, (a.astype(np.int32), np.searchsorted(wanted, b).astype(np.int32), new, wanted))]
    return out + [_row(owner, _MESSAGE, (block, wanted[on])) for owner, on in _by_block(wanted)]


def _vectors(block: int, by: dict) -> list:
    """Answers to requests: ids, vectors and worst similarities."""
    if not by[_VECTORS]:
        return []
    x, worst = by[_VECTORS][0]["x"], by[_WORST][0]
    out = []
    for asker, ids in by[_MESSAGE]:
        on = ids % _PLACE
        out.append(_row(asker, _MESSAGE, (ids, x[on], worst[on])))
    return out


def _compared(block: int, by: dict, degree: int) -> list:
    """Neighbours of neighbours: all pairs on a node's list with one new side, where they beat the worst."""
    if not by[_LISTS] or not by[_MESSAGE]:
        return []
    a, b, new, _ = by[_LISTS][0]
    ids = np.concatenate([m[0] for m in by[_MESSAGE]])  # each wanted node once, so in order they are `wanted`
    order = np.argsort(ids)
    ids = ids[order]
    x = np.concatenate([m[1] for m in by[_MESSAGE]])[order]
    worst = np.concatenate([m[2] for m in by[_MESSAGE]])[order]
    start = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0])) if len(a) else np.zeros(0, int)
    size = np.diff(np.append(start, len(a)))
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    waiting = 0

    def reduced(parts):
        f, t, s = (np.concatenate(c) for c in zip(*parts))
        pick = best_each(f, t, s, degree // 2)
        return [(f[pick], t[pick], s[pick])]

    for lo in range(0, len(start), 128):
        width = size[lo : lo + 128].max()
        at = np.minimum(start[lo : lo + 128][:, None] + np.arange(width), len(a) - 1)
        valid = np.arange(width) < size[lo : lo + 128][:, None]
        m, fresh = np.where(valid, b[at], 0), valid & new[at]
        g = x[m]
        sim = g @ g.transpose(0, 2, 1)
        good = (sim > worst[m][:, :, None]) & valid[:, :, None] & valid[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (m[:, :, None] != m[:, None, :])
        i, j, k = np.nonzero(good)
        held.append((m[i, j], m[i, k], sim[i, j, k]))
        waiting += len(i)
        if waiting > 2_000_000:
            held, waiting = reduced(held), 0
    f, t, s = reduced(held)[0]
    f, t = ids[f], ids[t]
    return [_row(owner, _MESSAGE, (f[on] % _PLACE, t[on], s[on])) for owner, on in _by_block(f)]


def _merged(block: int, by: dict, degree: int) -> list:
    """The state with what was found; all edges that took part are old now, those that came are new."""
    state = by[_STATE][0]
    at, place = np.nonzero(state["ids"] >= 0)
    n_old = len(at)
    a = np.concatenate([at, *[m[0] for m in by[_MESSAGE]]])
    b = np.concatenate([state["ids"][at, place], *[m[1] for m in by[_MESSAGE]]])
    s = np.concatenate([state["sims"][at, place], *[m[2] for m in by[_MESSAGE]]])
    old = np.arange(len(a)) < n_old
    # an edge that was never compared gives way to the same edge with its similarity
    pick = best_each(a, b, s, degree, old & np.isfinite(s))
    moved = int((~old[pick]).sum())
    return _told(block, _tabled(len(state["ids"]), degree, a[pick], b[pick], s[pick], old[pick]), moved)


def build(nodes: DataFrame, stages: Stages, dim: int, longest: float, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """nodes (block, node, vector, asked) to two tables with one row of packed arrays for each block: lists, and vectors."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()  # one short row for BLOCK nodes
    table = spark.sparkContext.broadcast((np.array([r["block"] for r in sizes], np.int64), np.array([r["n"] for r in sizes], np.float64)))

    def start(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x = matrix(frame["vector"].to_numpy(), dim)
        flat, block = lifted(x, longest), int(key[0])
        held = {"x": flat, "node": frame["node"].to_numpy(np.int64), "asked": frame["asked"].to_numpy(bool)}
        if not (flat[:, :dim] == x).all():  # else the short form says the same
            held["raw"] = x
        rows = [_row(block, _VECTORS, held), *_told(block, _start(block, flat, *table.value, degree))]
        return pd.DataFrame(rows, columns=["block", "kind", "payload", "moved"])

    kind = F.col("kind")
    first = stages.put(nodes.select("block", "node", "vector", "asked").groupBy("block").applyInPandas(start, _ROWS), "graph")
    vectors, now = stages.put(first.where(kind == _VECTORS), "vectors"), first.where(kind != _VECTORS)
    staged = first
    total = sum(r["n"] for r in sizes)
    for i in range(rounds):
        listed = stages.put(_step(now.where(kind != _WORST), _lists), "lists")
        answers = _step(vectors.unionByName(now.where(kind == _WORST)).unionByName(listed.where(kind == _MESSAGE)), _vectors)
        pairs = _step(listed.where(kind == _LISTS).unionByName(answers), lambda block, by: _compared(block, by, degree))
        after = stages.put(_step(now.where(kind == _STATE).unionByName(pairs), lambda block, by: _merged(block, by, degree)), "graph")
        stages.drop(staged, listed)
        now = staged = after
        moved = now.agg(F.sum("moved")).first()[0] or 0
        if moved <= SETTLED * total * degree:
            break
    out = stages.put(_step(now.where(kind != _WORST), _undirected), "undirected")
    stages.drop(staged)
    return out, vectors


def _undirected(block: int, by: dict) -> list:
    """For each node its neighbours, and up to REVERSE nodes that have it as theirs."""
    if not by[_STATE]:
        return []
    state = by[_STATE][0]
    a = np.concatenate([np.zeros(0, np.int64), *[m[0] for m in by[_MESSAGE]]])
    b = np.concatenate([np.zeros(0, np.int64), *[m[1] for m in by[_MESSAGE]]])
    own = np.flatnonzero((state["ids"] >= 0).ravel())
    mutual = _among(a, b, own // state["ids"].shape[1], state["ids"].ravel()[own])
    a, b = a[~mutual], b[~mutual]
    pick = best_each(a, b, np.zeros(len(a)), REVERSE)
    back = _tabled(len(state["ids"]), REVERSE, a[pick], b[pick], np.zeros(len(pick)), np.zeros(len(pick), bool))["ids"]
    return [_row(block, _STATE, np.hstack([state["ids"], back]))]


def _raw(held: dict, dim: int, on: np.ndarray) -> np.ndarray:
    return held["raw"][on] if "raw" in held else held["x"][on, :dim].astype(np.float64)


def _asked(block: int, by: dict, dim: int) -> list:
    """The queries of a block: a pool each of ids, scores and whether expanded; starts at the node and its neighbours."""
    held, both = by[_VECTORS][0], by[_STATE][0]
    on = np.flatnonzero(held["asked"])
    if not len(on):
        return []
    ids = np.column_stack([block * _PLACE + on, both[on]])
    pool = {"at": on, "who": held["node"][on], "q": _raw(held, dim, on), "ids": ids, "scores": np.full(ids.shape, np.nan), "nodes": np.full(ids.shape, -1, np.int64), "done": np.zeros(ids.shape, bool)}
    wanted = np.unique(ids[ids >= 0])
    return [_row(block, _LISTS, pool)] + [_row(owner, _MESSAGE, (block, wanted[p])) for owner, p in _by_block(wanted)]


def _raw_vectors(block: int, by: dict, dim: int) -> list:
    if not by[_VECTORS]:
        return []
    held = by[_VECTORS][0]
    return [_row(asker, _MESSAGE, (ids, _raw(held, dim, ids % _PLACE), held["node"][ids % _PLACE])) for asker, ids in by[_MESSAGE]]


def _scored(block: int, by: dict, k: int) -> list:
    """Pools with scores, cut to the POOL best; requests for the neighbours of the best not yet expanded.

    `moved` counts the queries of which one of the FRONT best nodes (k and itself at least) is not expanded yet.
    """
    if not by[_LISTS]:
        return []
    pool = by[_LISTS][0]
    ids = np.concatenate([np.zeros(0, np.int64), *[m[0] for m in by[_MESSAGE]]])
    order = np.argsort(ids)
    ids = ids[order]
    if len(ids):
        x = np.concatenate([m[1] for m in by[_MESSAGE]])[order]
        node = np.concatenate([m[2] for m in by[_MESSAGE]])[order]
    wide = [[], [], [], []]
    for i in range(len(pool["at"])):
        own, scores, nodes, done = pool["ids"][i], pool["scores"][i].copy(), pool["nodes"][i].copy(), pool["done"][i]
        blank = np.flatnonzero(np.isnan(scores) & (own >= 0))
        if len(blank):
            p = np.searchsorted(ids, own[blank])
            scores[blank], nodes[blank] = x[p] @ pool["q"][i], node[p]
        scores[own < 0] = -np.inf
        best = np.argsort(-scores, kind="stable")[:POOL]
        for column, value in zip(wide, (own, scores, nodes, done)):
            column.append(value[best])
    width = max(len(r) for r in wide[0])
    pad = lambda rows, fill: np.array([np.concatenate([r, np.full(width - len(r), fill, dtype=r.dtype)]) for r in rows])
    out = {**pool, "ids": pad(wide[0], -1), "scores": pad(wide[1], -np.inf), "nodes": pad(wide[2], -1), "done": pad(wide[3], False)}
    todo = ~out["done"] & (out["ids"] >= 0)
    open_ = todo[:, : max(FRONT, k + 1)].any(axis=1)
    todo &= (np.cumsum(todo, axis=1) <= EXPAND) & open_[:, None]
    out["done"] = out["done"] | todo
    out["todo"] = todo
    wanted = np.unique(out["ids"][todo])
    return [_row(block, _LISTS, out, open_.sum())] + [_row(owner, _MESSAGE, (block, wanted[p])) for owner, p in _by_block(wanted)]


def _adjacent(block: int, by: dict) -> list:
    if not by[_STATE]:
        return []
    return [_row(asker, _MESSAGE, (ids, by[_STATE][0][ids % _PLACE])) for asker, ids in by[_MESSAGE]]


def _widened(block: int, by: dict) -> list:
    """Pools with the neighbours of the nodes just expanded, and requests for their vectors."""
    if not by[_LISTS]:
        return []
    pool = by[_LISTS][0]
    ids = np.concatenate([np.zeros(0, np.int64), *[m[0] for m in by[_MESSAGE]]])
    order = np.argsort(ids)
    ids = ids[order]
    near = np.concatenate([m[1] for m in by[_MESSAGE]])[order] if len(ids) else np.zeros((0, 1), np.int64)
    rows = []
    for i in range(len(pool["at"])):
        found = np.unique(near[np.searchsorted(ids, pool["ids"][i][pool["todo"][i]])]) if len(ids) else ids
        rows.append(np.setdiff1d(found[found >= 0], pool["ids"][i]))
    width = max((len(r) for r in rows), default=0)
    more = np.array([np.concatenate([r, np.full(width - len(r), -1, np.int64)]) for r in rows]).reshape(len(rows), width)
    grown = {**pool, "ids": np.hstack([pool["ids"], more]), "scores": np.hstack([pool["scores"], np.full(more.shape, np.nan)]), "nodes": np.hstack([pool["nodes"], np.full(more.shape, -1)]), "done": np.hstack([pool["done"], np.zeros(more.shape, bool)])}
    wanted = np.unique(more[more >= 0])
    return [_row(block, _LISTS, grown)] + [_row(owner, _MESSAGE, (block, wanted[p])) for owner, p in _by_block(wanted)]


def search(graph: DataFrame, vectors: DataFrame, stages: Stages, dim: int, k: int, hops: int = HOPS) -> DataFrame:
    """asker, near, score: for each asked node the POOL best nodes that greedy search finds, itself among them."""
    is_list, is_message = F.col("kind") == _LISTS, F.col("kind") == _MESSAGE
    now = stages.put(_step(graph.unionByName(vectors), lambda block, by: _asked(block, by, dim)), "asked")
    for hop in range(hops + 1):
        answers = _step(vectors.unionByName(now.where(is_message)), lambda block, by: _raw_vectors(block, by, dim))
        scored = stages.put(_step(now.where(is_list).unionByName(answers), lambda block, by: _scored(block, by, k)), "scored")
        stages.drop(now)
        if hop == hops or not scored.agg(F.sum("moved")).first()[0]:
            break
        now = stages.put(_step(scored.where(is_list).unionByName(_step(graph.unionByName(scored.where(is_message)), _adjacent)), _widened), "widened")
        stages.drop(scored)

    def told(frames):
        for f in frames:
            for payload in f["payload"]:
                pool = pickle.loads(payload)  # noqa: S301  our own arrays
                keep = (pool["ids"] >= 0).ravel()
                yield pd.DataFrame({"asker": np.repeat(pool["who"], pool["ids"].shape[1])[keep], "near": pool["nodes"].ravel()[keep], "score": pool["scores"].ravel()[keep]})

    return scored.where(is_list).select("payload").mapInPandas(told, "asker long, near long, score double")


def nearest(points: DataFrame, stages: Stages, is_query, k: int = K, block: int = BLOCK) -> DataFrame:
    """points (id, vector array<double>, usable) to query_id, rank, id, score."""
    last = F.col("id").asc_nulls_last()
    rows = points.withColumn("uid", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("vector")).withColumn("h2", F.hash("vector", F.lit(1)))
    rows = stages.put(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))), "rows")
    # of each distinct vector the k + 1 smallest ids, in two steps, so that a common vector is not one task
    salted = Window.partitionBy("h", "h2", F.pmod("uid", F.lit(64))).orderBy(last, "uid")
    few = rows.withColumn("i", F.row_number().over(salted)).where(F.col("i") <= k + 1)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("h", "h2").orderBy(last, "uid"))).where(F.col("i") <= k + 1)
    ids = stages.put(few.select("h", "h2", "i", "id", "uid"), "ids")
    asked = rows.groupBy("h", "h2").agg(F.max("asked").alias("asked"))
    nodes = few.where("i = 1").select("h", "h2", F.col("uid").alias("node"), "vector").join(asked, ["h", "h2"])
    nodes = stages.put(nodes, "nodes")
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim"), F.coalesce(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1.0)).alias("top")).first()
    n, dim, longest = facts["n"], max(1, facts["dim"]), float(np.sqrt(facts["top"]))
    some = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").collect()
    depth = max(0, int(np.ceil(np.log2(max(1, n / block)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(some) / 4)))))
    tree = nodes.sparkSession.sparkContext.broadcast(Tree(matrix([r["vector"] for r in some], dim), depth))

    def leaf(frames):
        for f in frames:
            yield f.assign(leaf=tree.value.leaves(matrix(f["vector"].to_numpy(), dim)))

    dealt = stages.put(nodes.select("node", "vector", "asked").mapInPandas(leaf, "node long, vector array<double>, asked boolean, leaf long"), "leaves")
    parts = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (1.5 * block)).cast("long").alias("parts"))
    blocked = dealt.join(parts, "leaf").withColumn("block", F.col("leaf") * 4096 + F.pmod(F.xxhash64("node"), "parts"))
    empty = nodes.sparkSession.createDataFrame([], "asker long, near long, score double")
    found = stages.put(search(*build(blocked, stages, dim, longest), stages, dim, k) if n else empty, "found")
    # nodes back to rows: all ids kept of each node found, less the query's own row
    of_node = ids.where("i = 1").select("h", "h2", F.col("uid").alias("near"))
    spread = found.join(of_node, "near").join(ids.drop("i"), ["h", "h2"]).select("asker", "score", "id", "uid")
    ask = ids.where("i = 1").select("h", "h2", F.col("uid").alias("asker"))
    queries = rows.where("asked").select("h", "h2", F.col("id").alias("query_id"), F.col("uid").alias("query_uid")).join(ask, ["h", "h2"]).select("asker", "query_id", "query_uid")
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), last, "uid")
    best = queries.join(_top(spread, k), "asker").where("uid <> query_uid").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "score")


def _top(spread: DataFrame, k: int) -> DataFrame:
    """Of each asking node the k + 1 best rows: enough for any query on it, whose own row falls out."""
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return spread.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).drop("i")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "neighbours")
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding").where(usable(F.col("embedding")))
    vector = F.col("embedding").cast("array<double>")
    points = rows.where(F.exists(vector, lambda x: x != 0)).select(F.col("vec_id").alias("id"), vector.alias("vector"))
    return nearest(points, stages, F.col("id") % EVERY == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {"op6_neighbours": op6_neighbours}
ORACLE_SQL: dict[str, str] = {}
