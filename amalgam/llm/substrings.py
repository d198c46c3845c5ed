"""Substring deduplication by prefix-partitioned suffix trees over words.

Of all suffixes of a text those are kept that begin with the least-hashed gram of twelve words in some window of
50: equal windows then keep the same suffix, and one kept suffix, with the words before it that its windows cover,
stands for a run of windows. Suffixes are partitioned by their prefix, the gram; prefixes found in one distinct
text only have no inner node that counts and are dropped before any text moves. In each group two trees are
built: one of the suffixes, and one of what stands before them, read backwards. A window that begins o words
before its suffix is repeated wherever leaves share the suffix tree's inner node of depth 50 - o and the other
tree's node of depth o; the least document below both owns it. So the deep inner nodes give the maximal repeats,
and every window in them. Equal contexts are merged before the shuffle, and a group still over GROUP contexts
is split by the longest prefix, the window itself, whose node is then a plain minimum.

Exact copies are one text: its owner is the least doc_id that has it.

Cases: a null text has no words; a null doc_id counts as the largest; of rows with one doc_id none is
smaller than another; documents under 50 words lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, key_filter, read, words

WINDOW = 50
GRAM = 12
GROUP = 4_000
TABLE = 400_000
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd; polynomial hashes are taken modulo 2**64


class WordHashes:
    """64-bit hashes of words, with a bounded table."""

    def __init__(self):
        import xxhash

        self._hash, self._table = xxhash.xxh64_intdigest, {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        table = self._table
        try:
            return np.array([table[w] for w in ws], dtype=np.uint64)
        except KeyError:
            pass
        out = []
        for w in ws:
            h = table.get(w)
            if h is None:
                h = self._hash(w.encode("utf-8", "surrogatepass"))
                if len(table) < TABLE:
                    table[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, mixed so that its order is as good as random."""
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : len(out) + i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def prefixes(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes: (gram hash, first window, number of windows, words before the gram) for runs of windows with one gram."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3
    g = gram_hashes(h, gram)
    wide = window - gram + 1
    at = np.empty(n, dtype=np.int64)
    for lo in range(0, n, 1 << 15):
        part = np.lib.stride_tricks.sliding_window_view(g[lo : min(n, lo + (1 << 15)) + wide - 1], wide)
        at[lo : lo + len(part)] = part.argmin(axis=1) + np.arange(lo, lo + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]].view(np.int64), first.astype(np.int32), np.diff(np.append(first, n)).astype(np.int32), (at[first] - first).astype(np.int32)


def _digest(ws: list[str]) -> str:
    return hashlib.sha256(" ".join(ws).encode("utf-8", "surrogatepass")).hexdigest()


def _scan(docs: DataFrame, window: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            rows = []
            for doc, key, text in zip(f["doc"], f["tk"], f["text"]):
                ws = words(text)
                rows.append((doc, key, len(ws), _digest(ws), *prefixes(hashes(ws), window)))
            yield pd.DataFrame(rows, columns=["doc", "tk", "n_words", "sha", "grams", "lows", "counts", "leads"])

    return docs.mapInPandas(run, "doc long, tk long, n_words long, sha string, grams array<long>, lows array<int>, counts array<int>, leads array<int>")


def _contexts(held: DataFrame, window: int) -> DataFrame:
    """One row a kept suffix: all the words that its windows cover, and how many of them stand before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, owner, text, runs in zip(f["tk"], f["owner"], f["text"], f["runs"]):
                ws = words(text)
                for r in runs:
                    rows.append((r["gram"], key, owner, r["low"], r["lead"], " ".join(ws[r["low"] : r["low"] + r["n"] + window - 1])))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=["gram", "tk", "owner", "low", "lead", "context"])
                        rows = []
            yield pd.DataFrame(rows, columns=["gram", "tk", "owner", "low", "lead", "context"])

    return held.select("tk", "owner", "text", "runs").mapInPandas(run, "gram long, tk long, owner long, low int, lead int, context string")


def _suffixes(context: str, window: int) -> list[str]:
    ws = context.split(" ")
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = [0, *ends[:-1].tolist()]
    return [context[starts[j] : ends[j + window - 1] - 1] for j in range(len(ws) - window + 1)]


def _nodes(strings: list[list[str]], depths: list[range]) -> list[list[int]]:
    """The tree over the strings: for each of them, and each of its falling depths, the inner node at or below that depth.

    Strings are the leaves in order; a node is named by its first leaf. The stack holds the path of the current
    leaf: (depth at which it leaves the one before, place).
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out: list[list[int]] = [[]] * len(strings)
    path: list[tuple[int, int]] = []
    last: list[str] = []
    for place, i in enumerate(order):
        now = strings[i]
        shared = -1
        if place:
            shared = min(len(last), len(now))
            if last[:shared] != now[:shared]:
                shared = next(d for d, (x, y) in enumerate(zip(last, now)) if x != y)
        while path and path[-1][0] >= shared:
            path.pop()
        path.append((shared, place))
        last, at, found = now, len(path) - 1, []
        for depth in depths[i]:
            while path[at][0] >= depth:
                at -= 1
            found.append(path[at][1])
        out[i] = found
    return out


def subtree(contexts: list[str], leads: list[int], owners: list[int], window: int = WINDOW) -> list[list[int]]:
    """Of each context and each window in it, the least owner below the two inner nodes that the window's parts reach."""
    cut = [context.split(" ") for context in contexts]
    counts = [len(ws) - window + 1 for ws in cut]
    # the window that begins j words into its context has lead - j words before the suffix, and the rest in it
    after = _nodes([ws[lead:] for ws, lead in zip(cut, leads)], [range(n - 1 + window - lead, window - lead - 1, -1) for n, lead in zip(counts, leads)])
    before = _nodes([ws[:lead][::-1] for ws, lead in zip(cut, leads)], [range(lead, lead - n, -1) for n, lead in zip(counts, leads)])
    least: dict[tuple[int, int, int], int] = {}
    keys = [[(lead - j, after[c][-1 - j], before[c][j]) for j in range(n)] for c, (n, lead) in enumerate(zip(counts, leads))]
    for own, owner in zip(keys, owners):
        for key in own:
            if owner < least.get(key, owner + 1):
                least[key] = owner
    return [[least[key] for key in own] for own in keys]


def _trees(contexts: DataFrame, window: int) -> DataFrame:
    """contexts (gram, ck, context, lead, owner), groups together, to gram, ck, least: array by window."""

    def built(rows: list[tuple]) -> pd.DataFrame:
        least = subtree([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], window)
        return pd.DataFrame({"gram": [r[0] for r in rows], "ck": [r[1] for r in rows], "least": least})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: list[tuple] = []
        done: list[pd.DataFrame] = []
        size = 0
        for f in frames:
            for row in f.itertuples(index=False, name=None):
                if open_rows and row[0] != open_rows[0][0]:
                    done.append(built(open_rows))
                    size += len(open_rows)
                    open_rows = []
                    if size >= 5_000:
                        yield pd.concat(done)
                        done, size = [], 0
                open_rows.append(row)
        if open_rows:
            done.append(built(open_rows))
        if done:
            yield pd.concat(done)

    together = contexts.select("gram", "ck", "context", "lead", "owner").repartition("gram").sortWithinPartitions("gram", "ck")
    return together.mapInPandas(run, "gram long, ck long, least array<long>")


def _deep(contexts: DataFrame, window: int) -> DataFrame:
    """As _trees(), of groups too large for one: every window is a group of its own, summed up in two steps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for gram, ck, context, owner in f.itertuples(index=False, name=None):
                rows += [(gram, ck, j, hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest(), owner) for j, s in enumerate(_suffixes(context, window))]
            yield pd.DataFrame(rows, columns=["gram", "ck", "j", "window", "owner"])

    each = contexts.select("gram", "ck", "context", "owner").mapInPandas(run, "gram long, ck long, j int, window binary, owner long")
    least = each.groupBy("window").agg(F.min("owner").alias("least"))
    back = each.join(least, "window").groupBy("gram", "ck").agg(F.array_sort(F.collect_list(F.struct("j", "least"))).alias("l"))
    return back.select("gram", "ck", F.col("l.least").alias("least"))


def _cut(held: DataFrame, window: int) -> DataFrame:
    """Texts without the words that marked windows cover."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, text, starts in zip(f["tk"], f["text"], f["starts"]):
                ws = words(text)
                edge = np.zeros(len(ws) + 1, dtype=np.int64)
                s = np.unique(np.asarray(starts, dtype=np.int64))
                edge[s] += 1
                edge[s + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(ws, gone) if not g]
                rows.append((key, len(ws) - len(kept), _digest(kept), " ".join(kept)))
            yield pd.DataFrame(rows, columns=["tk", "cut", "cut_sha", "kept"])

    return held.select("tk", "text", "starts").mapInPandas(run, "tk long, cut long, cut_sha string, kept string")


def repeats(docs: DataFrame, stages: Stages, window: int = WINDOW, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) to: scanned rows, owners of texts, and the texts that lose words with what they keep."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")
    scanned = stages.put(_scan(keyed, window), "scanned")
    owners = stages.put(scanned.groupBy("tk").agg(F.min("doc").alias("owner")), "owners")
    firsts = scanned.where(F.size("grams") > 0).join(owners, "tk").where("doc = owner")
    runs = firsts.select("tk", F.explode(F.arrays_zip("grams", "lows", "counts", "leads")).alias("r")).select("tk", F.col("r.grams").alias("gram"), F.col("r.lows").alias("low"), F.col("r.counts").alias("n"), F.col("r.leads").alias("lead"))
    runs = stages.put(runs, "runs")
    shared = runs.groupBy("gram").agg(F.min("tk").alias("a"), F.max("tk").alias("b")).where("a <> b").select("gram")
    shared = stages.put(shared, "shared")  # a table, so that the join below is one that can split a gram that many texts hold
    by_text = runs.where(key_filter(shared)("gram")).join(shared, "gram").groupBy("tk").agg(F.collect_set(F.struct("gram", "low", "n", "lead")).alias("runs")).join(owners, "tk")
    held = stages.put(keyed.join(by_text, "tk").where("doc = owner"), "held")
    stages.drop(runs)
    contexts = stages.put(_contexts(held, window).withColumn("ck", F.xxhash64("context", "lead")), "contexts")
    merged = contexts.groupBy("gram", "ck").agg(F.first("context").alias("context"), F.first("lead").alias("lead"), F.min("owner").alias("owner"))
    merged = stages.put(merged, "merged")
    large = merged.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group).select("gram")
    least = _trees(merged.join(large, "gram", "left_anti"), window).unionByName(_deep(merged.join(large, "gram", "left_semi"), window))
    least = stages.put(least, "least")
    marked = contexts.drop("context", "lead").join(least, ["gram", "ck"])
    own = F.filter(F.sequence(F.lit(0), F.size("least") - 1), lambda j: F.element_at("least", j + 1) < F.col("owner"))
    marked = marked.withColumn("starts", F.transform(own, lambda j: j + F.col("low"))).where(F.size("starts") > 0)
    starts = marked.groupBy("tk").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    cut = stages.put(_cut(held.dropDuplicates(["tk"]).join(starts, "tk"), window), "cut")
    stages.drop(contexts, merged, least, held)
    return scanned, owners, cut


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "substrings")
    scanned, owners, cut = repeats(read(spark, sf_dir, "documents", "doc_id", "text"), stages)
    rows = scanned.select("doc", "tk", "n_words", "sha").join(owners, "tk").join(cut.select("tk", "cut", "cut_sha"), "tk", "left")
    copy = (F.col("doc") > F.col("owner")) & (F.col("n_words") >= WINDOW)
    first = F.col("doc") == F.col("owner")
    return rows.select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).when(first, F.coalesce("cut", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(first, F.coalesce("cut_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


QUERIES = {"op5_substrings": op5_substrings}
ORACLE_SQL: dict[str, str] = {}
