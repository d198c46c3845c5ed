"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Hyperplanes, fitted on at most SAMPLE vectors, deal every vector to a shard near its likes; shards over twice
their size are split by hash. Each shard is one staged row that holds its built ball tree, whose root bounds every
score in it: q.c + |q| r. Queries go in waves: first each to the shard with its highest bound, then to the next
NEXT by bound, then to all others, and before each wave the k-th score so far is shared: a shard whose bound is
below it is never sent the query. Within a shard each query visits the nodes by falling bound while its k-th
score rises. Bounds are computed for blocks of queries against blocks of roots, and only pairs that pass become
rows; a shard's row is read once, followed by its queries in bounded batches.

Cases: vectors null or holding null or non-finite components take no part; of vectors of several lengths
missing components count as 0; repeated rows are candidates of one another; ties go to the smaller id. Whole
numbers too large for exact products of doubles are multiplied as Python integers, so the order is exact up to
38 digits; a score beyond the range of long is given as its bound. With numbers that are not whole, scores are
the products of doubles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, read
from amalgam.llm.planes import Tree, matrix, usable

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 16_384
SAMPLE = 20_000
LEAF = 128
NEXT = 8
ROOTS = 4_096
BATCH = 8_192
_ROWS = "shard long, kind int, uid long, payload binary, floor double"
_FOUND = "query_uid long, uid long, score double, exact string"
_EXACT = 2.0**53


class BallTree:
    """Nodes in arrays: rows lo..hi of the ordered vectors, centre, radius, and two halves unless it is a leaf.

    Rows come in order of their id, then uid: the smaller place wins a tie.
    """

    def __init__(self, uids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        rows, centres, radii, halves = [], [], [], []

        def grow(lo: int, hi: int) -> int:
            part = x[order[lo:hi]]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            me = len(rows)
            rows.append((lo, hi))
            centres.append(centre)
            radii.append(radius)
            halves.append((-1, -1))
            if hi - lo > leaf and radius > 0:
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                order[lo:hi] = order[lo:hi][np.argsort(part[:, axis], kind="stable")]
                mid = (lo + hi) // 2
                halves[me] = (grow(lo, mid), grow(mid, hi))
            return me

        if len(x):
            grow(0, len(x))
        self.rows, self.halves = rows, halves
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.x, self.uids, self.places, self.named = x[order], uids[order], order, uids
        self.longest = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
        self.whole = bool((x == np.floor(x)).all())

    def slack(self, norms: np.ndarray) -> np.ndarray:
        """More than rounding can take from a bound."""
        return 1e-9 * (1 + norms * (self.longest + 1))

    def search(self, uids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the k best (score, place) of rows other than its own, none below its floor; ties to the smaller place.

        Scores are Python integers where products of doubles would not be exact.
        """
        n = len(q)
        norm = np.sqrt((q * q).sum(axis=1))
        large = self.whole and n > 0 and float(norm.max()) * self.longest >= _EXACT and bool((q == np.floor(q)).all())
        kind = object if large else float
        best = np.full((n, k), -np.inf, dtype=kind)
        who = np.full((n, k), np.iinfo(np.int64).max)
        slack = self.slack(norm)
        whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)

        def bound(node: int, on: np.ndarray) -> np.ndarray:
            return q[on] @ self.centres[node] + norm[on] * self.radii[node] + slack[on]

        def open_for(on: np.ndarray, reach: np.ndarray) -> np.ndarray:
            kth = best[on, -1]
            if large:
                kth = np.array([v if v == -np.inf else float(v) * (1 - 1e-15 * np.sign(float(v))) for v in kth], dtype=float)
            return reach >= np.maximum(kth, floor[on])

        def visit(node: int, on: np.ndarray) -> None:
            if not len(on):
                return
            a, b = self.halves[node]
            if a >= 0:
                to_a, to_b = bound(a, on), bound(b, on)
                a_first = to_a >= to_b
                for first, then, mine, reach, other in ((a, b, a_first, to_a, to_b), (b, a, ~a_first, to_b, to_a)):
                    own = on[mine]
                    if len(own):
                        visit(first, own[open_for(own, reach[mine])])
                        visit(then, own[open_for(own, other[mine])])
                return
            lo, hi = self.rows[node]
            for at in range(lo, hi, 4096):  # a ball of equal vectors is a leaf of any size
                to = min(hi, at + 4096)
                s = whole(q[on]) @ whole(self.x[at:to]).T if large else q[on] @ self.x[at:to].T
                s[self.uids[at:to][None, :] == uids[on][:, None]] = -np.inf
                s[s < floor[on][:, None]] = -np.inf
                scores = np.concatenate([best[on], s], axis=1)
                names = np.concatenate([who[on], np.broadcast_to(self.places[at:to], s.shape)], axis=1)
                if large:
                    pick = np.array([sorted(range(len(r)), key=lambda j: (-r[j], m[j]))[:k] for r, m in zip(scores, names)])
                else:
                    pick = np.lexsort((names, -scores), axis=1)[:, :k]
                best[on] = np.take_along_axis(scores, pick, axis=1)
                who[on] = np.take_along_axis(names, pick, axis=1)

        if len(self.x):
            start = np.arange(n)
            visit(0, start[open_for(start, bound(0, start))])
        return best, who


def _tree_rows(points: DataFrame, dim: int) -> DataFrame:
    """points (shard, uid, id, vector) to one row a shard, its built tree; a shard is a bounded block by construction."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "uid"], na_position="last")
        tree = BallTree(frame["uid"].to_numpy(np.int64), matrix(frame["vector"].to_numpy(), dim))
        root = np.concatenate([tree.centres[0], [tree.radii[0], tree.longest]])
        return pd.DataFrame({"shard": [key[0]], "kind": [0], "uid": [len(frame)], "payload": [pickle.dumps(tree, protocol=5)], "floor": [0.0], "root": [root.tobytes()]})

    return points.groupBy("shard").applyInPandas(build, _ROWS + ", root binary")


def _search(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """rows: a shard's tree (kind 0), then its queries (kind 1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at = None, None
        for frame in frames:
            for shard, part in frame.groupby("shard", sort=False):
                heads = part[part.kind == 0]
                if len(heads):
                    tree, at = pickle.loads(heads.payload.iloc[0]), shard  # noqa: S301  our own tree
                asked = part[part.kind == 1]
                if not len(asked) or at != shard:
                    continue
                uids = asked.uid.to_numpy(np.int64)
                q = np.frombuffer(b"".join(asked.payload), np.float64).reshape(len(asked), dim)
                best, who = tree.search(uids, q, asked.floor.to_numpy(float), k)
                good = best > -np.inf
                scores = best[good]
                exact = [str(int(v)) if isinstance(v, int) else None for v in scores]
                yield pd.DataFrame({"query_uid": np.repeat(uids, k)[good.ravel()], "uid": tree.named[who[good]], "score": [float(v) for v in scores], "exact": pd.Series(exact, dtype=object)})

    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "uid").mapInPandas(run, _FOUND)


def _reached(asked: DataFrame, roots: DataFrame, blocks: int, batches: int, dim: int, most: int | None, searched: DataFrame | None) -> DataFrame:
    """asked (uid, payload, floor) to (uid, shard, bound): shards whose bound reaches the query's floor, the `most` best.

    `blocks` of ROOTS roots meet `batches` of BATCH queries, a task each; only pairs that pass become rows.
    """
    share = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asked.withColumn("block", share(blocks)).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int"))
    packed = roots.withColumn("part", share(batches)).select("block", "part", F.lit(0).alias("kind"), F.col("shard").alias("uid"), F.col("root").alias("payload"), F.lit(0.0).alias("floor"))
    rows = packed.unionByName(sent.select("block", "part", F.lit(1).alias("kind"), "uid", "payload", "floor"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for frame in frames:
            for block, part in frame.groupby(["block", "part"], sort=False):
                heads = part[part.kind == 0]
                if len(heads):
                    held = {block: held.get(block, []) + [(heads.uid.to_numpy(np.int64), np.frombuffer(b"".join(heads.payload), np.float64).reshape(len(heads), dim + 2))]}
                mine = part[part.kind == 1]
                if not len(mine) or block not in held:
                    continue
                shards = np.concatenate([s for s, _ in held[block]])
                root = np.concatenate([r for _, r in held[block]])
                for lo in range(0, len(mine), 256):
                    own = mine.iloc[lo : lo + 256]
                    q = np.frombuffer(b"".join(own.payload), np.float64).reshape(len(own), dim)
                    norm = np.sqrt((q * q).sum(axis=1))[:, None]
                    bound = q @ root[:, :dim].T + norm * root[:, dim] + 1e-9 * (1 + norm * (root[:, dim + 1] + 1))
                    good = bound >= own.floor.to_numpy(float)[:, None]
                    if most and most < bound.shape[1]:
                        cut = -np.partition(-np.where(good, bound, -np.inf), most - 1, axis=1)[:, most - 1 : most]
                        good &= bound >= cut
                    i, j = np.nonzero(good)
                    yield pd.DataFrame({"uid": own.uid.to_numpy(np.int64)[i], "shard": shards[j], "bound": bound[i, j]})

    found = rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "uid").mapInPandas(run, "uid long, shard long, bound double")
    if searched is not None:
        found = found.join(searched, ["uid", "shard"], "left_anti")
    if most:
        found = found.withColumn("i", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("bound"), "shard"))).where(F.col("i") <= most).drop("i")
    return found


def _value() -> F.Column:
    return F.coalesce(F.col("exact").try_cast("decimal(38,0)"), F.when(F.col("exact").isNull() & (F.col("score") == F.floor("score")), F.col("score").try_cast("decimal(38,0)")))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; at most k rows of each shard come in."""
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.desc_nulls_last(_value()), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(points: DataFrame, stages: Stages, is_query, k: int = K, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """points (id, vector array<double>) to query_id, rank, id, score (double), exact (text, for whole numbers beyond 2**53)."""
    kept = stages.put(points.withColumn("uid", F.monotonically_increasing_id()), "points")
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).first()
    dim, depth = max(1, size["dim"]), max(0, int(np.ceil(np.log2(max(1, size["n"] / shard_rows)))))
    some = kept.orderBy(F.xxhash64("uid")).limit(sample).select("vector").collect() if depth else []
    depth = min(depth, max(0, int(np.log2(max(1, len(some) / 4)))))
    planes = kept.sparkSession.sparkContext.broadcast(Tree(matrix([r["vector"] for r in some], dim), depth))

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"uid": f["uid"], "leaf": planes.value.leaves(matrix(f["vector"].to_numpy(), dim))})

    leaves = stages.put(kept.select("uid", "vector").mapInPandas(leaf, "uid long, leaf long"), "leaves")
    parts = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).cast("long").alias("parts"))
    shards = leaves.join(parts, "leaf").select("uid", (F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("uid"), "parts")).alias("shard"))
    trees = stages.put(_tree_rows(kept.join(shards, "uid"), dim), "trees")
    blocks = max(1, -(-size["n"] // (shard_rows * ROOTS)))
    roots = stages.put(trees.select("shard", "root", F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int").alias("block")), "roots")

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"uid": f["uid"], "payload": [r.tobytes() for r in matrix(f["vector"].to_numpy(), dim)]})

    asked = stages.put(kept.where(is_query).select("uid", "vector").mapInPandas(packed, "uid long, payload binary"), "queries")
    ids = kept.select("uid", "id")
    batches = max(1, -(-asked.count() // BATCH))
    floors = asked.withColumn("floor", F.lit(float("-inf")))
    done = searched = None
    for wave, most in (("first", 1), ("next", NEXT), ("rest", None)):
        reached = stages.put(_reached(floors, roots, blocks, batches, dim, most, searched), f"reached-{wave}")
        sent = reached.join(floors, "uid").select("shard", F.lit(1).alias("kind"), "uid", "payload", "floor")
        found = stages.put(_search(trees.drop("root").unionByName(sent), dim, k).join(ids, "uid"), f"found-{wave}")
        done = stages.put(_best(found if done is None else done.unionByName(found), k).drop("rank"), f"best-{wave}")
        searched = reached.select("uid", "shard") if searched is None else searched.unionByName(reached.select("uid", "shard"))
        kth = done.groupBy(F.col("query_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        # a little less than the k-th score, where a double may stand above the whole number that it is for
        low = F.col("kth") - F.abs("kth") * 1e-15
        floors = asked.join(kth, "uid", "left").select("uid", "payload", F.when(F.col("n") >= k, low).otherwise(F.lit(float("-inf"))).alias("floor"))
    best = _best(done, k).join(ids.select(F.col("uid").alias("query_uid"), F.col("id").alias("query_id")), "query_uid")
    return best.select("query_id", "rank", "id", "score", "exact")


def as_long() -> F.Column:
    """The score as long; beyond its range, the bound that is next to it."""
    low, high = -(2**63), 2**63 - 1
    value = F.least(F.greatest(_value(), F.lit(low).cast("decimal(38,0)")), F.lit(high).cast("decimal(38,0)"))
    return F.coalesce(value.cast("long"), F.when(F.col("score") > 0, F.lit(high)).otherwise(F.lit(low)))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "topk")
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding").where(usable(F.col("embedding")))
    scaled = lambda x: F.when(F.abs(x * SCALE) < _EXACT, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)  # noqa: E731  larger doubles are whole
    whole = F.transform(F.col("embedding").cast("array<double>"), scaled)
    points = rows.select(F.col("vec_id").alias("id"), whole.alias("vector"))
    out = exact_topk(points, stages, F.col("id") % EVERY == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), as_long().alias("score"))


_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op10_topk": op10_topk}
ORACLE_SQL = {"op10_topk": _SQL}
