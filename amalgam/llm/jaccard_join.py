"""N-gram Jaccard join by chosen paths: near duplicates on sets of five-word shingles.

Words are the text's words in lower case; texts under five words are one shingle. Equal sets are one set
with a number of copies. A set is known by its minima under TRIALS hash functions. In each run a node of
the path tree picks a few of these positions (1 / threshold on average) and sends each set to the child
that its minimum there names, so two sets go together with a chance equal to their similarity; buckets up
to BUCKET sets are compared all against all by their minima, larger ones are split again, and runs repeat
until a pair at the threshold is missed with a chance of at most 1 - RECALL. Each split can lose a pair, so
the sets of split buckets get the runs that the deepest level asks for. What may be similar is joined
to connected groups, each set is sent to its one group, and there all pairs are verified on whole sets.
Only counts and a spanning forest leave a group, so a group of n near copies gives rows in proportion to n.
A group too large for a task is cut into blocks, and all pairs of blocks are verified.

Result: a row per document with its class (the least doc_id of its connected group of links) and its links:
other documents whose similarity is at least the threshold, copies included.

Cases: null, empty and blank texts have no shingles, so no links and a class of their own; a null doc_id
counts as the largest, and a class of none but such rows is null; repeated rows are copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, components, key_filter, read, words
from amalgam.llm.substrings import LAST, WordHashes, gram_hashes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
TRIALS = 128
BUCKET = 2_000
DEPTH = 10
#: Estimates from minima err by about 0.035 at the threshold; this lies more than five such errors below.
CANDIDATE = 0.6
BLOCK_SETS = 1_500
BLOCK_SHINGLES = 2_000_000

_rng = np.random.default_rng(20_240_229)
_A = (_rng.integers(1, 1 << 62, TRIALS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 62, TRIALS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of k words."""
    ws = words(text.lower()) if text else []
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(gram_hashes(hashes(ws), min(k, len(ws))) + np.uint64(k - min(k, len(ws))))


def minima(s: np.ndarray) -> np.ndarray:
    """The least of the set's elements under each hash function, as 32 bits."""
    out = np.full(TRIALS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(s), 1024):
        np.minimum(out, (s[lo : lo + 1024, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hashes = WordHashes()
        for f in frames:
            rows = []
            for doc, row, text in zip(f["doc"], f["row"], f["text"]):
                s = shingles(text, hashes, k)
                key = np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64) if len(s) else 0
                rows.append((doc, row, key, len(s), minima(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc", "row", "key", "n", "minima"])

    return docs.mapInPandas(run, "doc long, row long, key long, n long, minima binary")


def _sketched(sets: DataFrame) -> DataFrame:
    """sets with `sketch`: the low byte of each minimum."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(sketch=[np.frombuffer(m, dtype=np.uint8)[::4].tobytes() for m in f["minima"]])

    return sets.mapInPandas(run, ", ".join(f"{name} {kind}" for name, kind in sets.dtypes) + ", sketch binary")


def positions(path: int, threshold: float) -> list[int]:
    """The positions that a node picks: 1 / threshold on average, at least one."""
    rng = np.random.default_rng(path & ((1 << 63) - 1))
    mean = 1 / threshold
    return rng.choice(TRIALS, size=int(mean) + (rng.random() < mean % 1), replace=False).tolist()


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (path, key, minima, perhaps part) to path of each child, key, and the part."""
    kept = [c for c in ("key", "part") if c in rows.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            m = np.frombuffer(b"".join(f["minima"]), dtype="<u4").reshape(len(f), TRIALS)
            path = f["path"].to_numpy(np.int64)
            for p in np.unique(path):
                on = np.flatnonzero(path == p)
                own = {c: f[c].to_numpy(np.int64)[on] for c in kept}
                for i in positions(int(p), threshold):
                    child = _mix(m[on, i].astype(np.uint64) + _mix(np.array([p], np.int64).view(np.uint64) + np.uint64(i * 7919 + 1)))
                    yield pd.DataFrame({"path": child.view(np.int64), **own})

    return rows.select("path", "minima", *kept).mapInPandas(run, ", ".join(f"{c} long" for c in ("path", *kept)))


def _grouped(frames: Iterator[pd.DataFrame], by: list[str], work) -> Iterator[pd.DataFrame]:
    """Run `work` on each group of frames that come sorted by it; a group may span frames."""
    open_part: list[pd.DataFrame] = []
    out: list[pd.DataFrame] = []
    size = 0
    at = None
    for f in frames:
        if not len(f):
            continue
        keys = f[by].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(f)]
        for lo, hi in zip(edges, edges[1:]):
            now = tuple(keys[lo])
            if open_part and now != at:
                out.append(work(pd.concat(open_part) if len(open_part) > 1 else open_part[0]))
                size += len(out[-1])
                open_part = []
            at = now
            open_part.append(f.iloc[lo:hi])
        if size > 10_000:
            yield pd.concat(out)
            out, size = [], 0
    if open_part:
        out.append(work(pd.concat(open_part)))
    if out:
        yield pd.concat(out)


def _roots(n: int, linked) -> np.ndarray:
    """Labels 0..n-1 merged by linked(i): the least index of each connected part."""
    label = np.arange(n)
    for i in range(n):
        r = np.unique(label[np.append(linked(i), i)])
        if len(r) > 1:
            label[np.isin(label, r)] = r[0]
    return label


def _bucket_edges(rows: DataFrame) -> DataFrame:
    """rows (path, key, sketch) of small buckets to a spanning forest of what may be similar.

    A sketch holds the low byte of each minimum; a byte is equal by chance once in 256 times.
    """

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("key")
        key = g["key"].to_numpy(np.int64)
        m = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(g), TRIALS)
        label = _roots(len(g), lambda i: np.flatnonzero(((m == m[i]).mean(axis=1) - 1 / 256) * 256 / 255 >= CANDIDATE))
        on = label != np.arange(len(g))
        return pd.DataFrame({"a": key[on], "b": key[label[on]]})

    together = rows.select("path", "key", "sketch").repartition("path").sortWithinPartitions("path", "key")
    return together.mapInPandas(lambda frames: _grouped(frames, ["path"], work), "a long, b long")


def survival(similar: float, threshold: float, depth: int) -> float:
    """The chance that a pair agreeing in this share of positions is still together in a run at this depth.

    All pairs share the few roots, so these count with the fewest positions that a node can pick, not the mean.
    """
    mean, p = 1 / threshold, 1.0
    for level in range(depth, 0, -1):
        apart = 1 - similar * p
        p = 1 - apart ** int(mean) * (1 - (mean % 1 if level > 1 else 0) * (1 - apart))
    return p


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with a chance of at most (1 - recall) / 2 though buckets reach
    this depth; the mean over how many of the TRIALS positions agree, because all runs draw from the same ones."""
    agree = np.arange(TRIALS + 1)
    log_n = np.array([math.lgamma(i + 1) for i in range(TRIALS + 1)])
    weight = np.exp(log_n[-1] - log_n - log_n[::-1] + agree * math.log(threshold) + (TRIALS - agree) * math.log(1 - threshold)) if threshold < 1 else (agree == TRIALS).astype(float)
    lost = np.array([1 - survival(i / TRIALS, threshold, depth) for i in agree])
    n = 1
    while (weight * lost**n).sum() > (1 - recall) / 2:
        n += 1
    return n


def _run(sets: DataFrame, runs: range, stages: Stages, threshold: float, bucket: int) -> tuple[list[DataFrame], int, DataFrame | None]:
    """Edges of these runs, the depth reached, and the sets that lay in large buckets at depth 1.

    If sets have a column `part`, buckets that lie in one part are left out: their sets are connected already.
    """
    now = sets.select(F.explode(F.array(*[F.lit(r).cast("long") for r in runs])).alias("path"), *[c for c in sets.columns if c != "sketch"])
    active = sets  # sets that the current level can hold
    edges, first = [], None
    for depth in range(1, DEPTH + 1):
        level = stages.put(_children(now, threshold), f"paths{depth}")
        if "part" in sets.columns:
            counts = level.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("path", "m")
        else:
            counts = level.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        sized = stages.put(level.join(counts, "path").select("path", "key", "m"), f"sized{depth}")
        stages.drop(level)
        edges.append(stages.put(_bucket_edges(sized.where(F.col("m") <= bucket).join(active.select("key", "sketch"), "key")), f"edges{depth}"))
        hubs = sized.where(F.col("m") > bucket).select("path", "key")
        if not hubs.limit(1).count():
            stages.drop(sized)
            break
        if depth == DEPTH:  # equal at ten positions in turn: verified below like the rest
            edges.append(hubs.join(hubs.groupBy("path").agg(F.min("key").alias("b")), "path").select(F.col("key").alias("a"), "b"))
            break
        keys = stages.put(hubs.select("key").distinct(), f"hubs{depth}")
        active, before = stages.put(active.where(key_filter(keys)("key")).join(keys, "key", "left_semi"), f"active{depth}"), active
        if depth > 2:
            stages.drop(before)
        first = active if first is None else first
        now = hubs.join(active.drop("sketch"), "key")
    return edges, depth, first


def candidates(sets: DataFrame, stages: Stages, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """sets (key, minima, sketch) to edges (a, b) that connect all sets that may be similar.

    A pair that a split lost lay in a large bucket at depth 1, so further runs, as many as the depth reached asks
    for, take the sets of such buckets only, and of these buckets those whose sets are not connected yet.
    """
    done = runs_needed(threshold, recall, 1)
    sets = sets.select("key", "minima", "sketch")
    edges, depth, split = _run(sets, range(done), stages, threshold, bucket)
    while (needed := runs_needed(threshold, recall, depth)) > done:
        parts = components(reduce(DataFrame.unionByName, edges), stages).select(F.col("v").alias("key"), F.col("c").alias("part"))
        again = stages.put(split.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "again")
        more, reached, _ = _run(again, range(done, needed), stages, threshold, bucket)
        edges, depth, done = edges + more, max(depth, reached), needed
    return reduce(DataFrame.unionByName, edges)


def _intersections(sets: list[np.ndarray]):
    """A function that gives, for set i, the sizes of its intersections with all sets."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse = np.unique(flat, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
    begin = np.concatenate([[0], np.cumsum(sizes)])

    def one(i: int) -> np.ndarray:
        e = inverse[begin[i] : begin[i + 1]]
        n = start[e + 1] - start[e]
        at = np.repeat(start[e] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(posting[at], minlength=len(sets))

    return one, sizes


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (grp, lo, hi, block, key, copies, shingles) to key, linked documents, and a forest edge."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("key")
        key, copies, block = (g[c].to_numpy(np.int64) for c in ("key", "copies", "block"))
        one, sizes = _intersections([np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]])
        cross = g["lo"].iloc[0] != g["hi"].iloc[0]
        links = np.zeros(len(g), dtype=np.int64)

        def linked(i: int) -> np.ndarray:
            n = one(i)
            good = n >= threshold * (sizes + sizes[i] - n) - 1e-9
            good[i] = False
            if cross:
                good &= block != block[i]
            links[i] = copies[good].sum()
            return np.flatnonzero(good)

        label = _roots(len(g), linked)
        return pd.DataFrame({"key": key, "links": links, "root": key[label]})

    by = ["grp", "lo", "hi"]
    together = rows.repartition(*by).sortWithinPartitions(*by, "key")
    return together.mapInPandas(lambda frames: _grouped(frames, by, work), "key long, links long, root long")


def _shingled(texts: DataFrame, k: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            yield f.drop(columns="text").assign(shingles=[shingles(t, hashes, k).tobytes() for t in f["text"]])

    return texts.mapInPandas(run, "grp long, nb long, key long, copies long, shingles binary")


def row_key() -> F.Column:
    """A key of the row's doc_id and text; repeated rows share it."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def jaccard_classes(docs: DataFrame, stages: Stages, threshold: float = THRESHOLD, recall: float = RECALL, k: int = WORDS, bucket: int = BUCKET, block_sets: int = BLOCK_SETS) -> DataFrame:
    """docs (doc_id, text) to row (see row_key), doc_id, class_id, n_links, and the row of the class that stays."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), row_key().alias("row"), "text")
    scanned = stages.put(_sets(keyed, k), "scanned")
    sets = scanned.where("n > 0").groupBy("key").agg(F.min("doc").alias("owner"), F.min_by("row", F.struct("doc", "row")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("minima").alias("minima"))
    sets = stages.put(_sketched(sets), "sets")
    whole, scanned = scanned, stages.put(scanned.drop("minima"), "rows")
    stages.drop(whole)
    groups = components(candidates(sets, stages, threshold, recall, bucket), stages)
    members = groups.select(F.col("v").alias("key"), F.col("c").alias("grp")).join(sets.select("key", "row", "copies", "n"), "key")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("nb"))
    members = stages.put(members.join(sizes, "grp").select("row", "grp", "nb", "key", "copies"), "members")
    # only texts that may be wanted move; the filter's few false ones fall out in the join. They are staged in
    # between, so that no task runs the filter's Python worker beside that of the shingles
    wanted = stages.put(keyed.select("row", "text").where(key_filter(members.select("row"))("row")), "wanted")
    texts = wanted.join(members, "row").select("grp", "nb", "key", "copies", "text")
    cut = _shingled(texts, k).withColumn("block", F.pmod(F.xxhash64("key"), "nb"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    cut = cut.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "copies", "shingles")
    found = stages.put(_verified(cut, threshold), "verified")
    stages.drop(wanted)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), stages)
    own = sets.select("key", "owner", "row", "copies").join(joined.select(F.col("v").alias("key"), "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    classes = own.groupBy("c").agg(F.min("owner").alias("class"), F.min_by("row", F.struct("owner", "row")).alias("stays"))
    own = own.join(classes, "c").join(links, "key", "left").select("key", "class", "stays", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = scanned.select("doc", "row", "key", "n").join(own, "key", "left")
    some = F.col("n") > 0
    return out.select(
        "row",
        F.when(some, F.col("stays")).otherwise(F.col("row")).alias("stays"),
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
        F.when(F.when(some, F.col("class")).otherwise(F.col("doc")) != LAST, F.when(some, F.col("class")).otherwise(F.col("doc"))).alias("class_id"),
        F.when(some, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir, "documents", "doc_id", "text"), Stages(spark, "jaccard")).select("doc_id", "class_id", "n_links")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
