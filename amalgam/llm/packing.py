"""Best-fit packing of tokenised documents into fixed-length sequences, with swap-based local search.

Only lengths matter to a packing and there are at most `capacity` of them, so the driver packs the
histogram of lengths: a bin pattern is a list of (length, copies) with a multiplicity, and best fit in
order of falling length acts on whole patterns at once. That takes a number of patterns bounded by the
capacity, whatever the number of documents. Local search then moves one document, or exchanges one for
one or two for one, between underfull bins wherever that raises the sum of squared fills, until the
lower bound is met or nothing helps; it too acts on all equal bins at once, and no number of tries bounds
it. Pieces are numbered within their length and look their place up in the plan.

Cases: a null text is empty and gives one piece that holds the end token alone; an empty table gives
no pieces; repeated rows are packed each on their own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, numbered, read

CAPACITY = 4096
END_ID = 1
_SHIFT = 48


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) to one row a piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from amalgam.llm.tokens import WordTokenizer

        tokenizer = WordTokenizer(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokenizer.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, type=t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bin:
    """`many` equal bins: how many documents of each length, and how full."""

    __slots__ = ("fill", "items", "many")

    def __init__(self, items: dict[int, int], many: int):
        self.items, self.many = items, many
        self.fill = sum(n * k for n, k in items.items())

    def key(self):
        return tuple(sorted(self.items.items(), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Best fit by falling length; every step acts on all bins of one residual at once."""
    open_by: dict[int, list[Bin]] = defaultdict(list)
    some = 0  # bit r: there is a bin with residual r
    done: list[Bin] = []

    def put(b: Bin) -> None:
        nonlocal some
        room = capacity - b.fill
        if room:
            open_by[room].append(b)
            some |= 1 << room
        else:
            done.append(b)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            tight = some >> length
            if not tight:
                each = capacity // length
                if left // each:
                    put(Bin({length: each}, left // each))
                if left % each:
                    put(Bin({length: left % each}, 1))
                break
            room = length + (tight & -tight).bit_length() - 1
            b = open_by[room].pop()
            if not open_by[room]:
                some &= ~(1 << room)
            each = room // length
            take = min(b.many, left // each)
            if take == 0:
                each, take = left, 1
            if take < b.many:
                put(Bin(dict(b.items), b.many - take))
            left -= each * take
            put(Bin({**b.items, length: b.items.get(length, 0) + each}, take))
    return done + [b for bins in open_by.values() for b in bins]


def _moved(b: Bin, out: list[int], back: list[int]) -> dict[int, int]:
    items = Counter(b.items)
    items.subtract(out)
    items.update(back)
    return {n: k for n, k in items.items() if k}


class _Underfull:
    """Distinct underfull patterns in the order they came up, and what each could give back in an exchange.

    Entry i of the flat arrays: pattern `owner[i]` gives back length `back[i]` (0: nothing) and then takes up to `reach[i]`.
    A pattern that runs out and comes up again is a new one, so a pair that failed once need not be tried again.
    """

    def __init__(self, capacity: int):
        self.capacity, self.n, self.size = capacity, 0, 0
        self.bins: list[Bin] = []
        self.alive: dict[tuple, int] = {}
        self.order: list[tuple[int, int, int]] = []  # those alive by (scale of `many`, fill): most bins, then emptiest first
        self.owner, self.back, self.reach = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.start, self.seen = [0], []
        self.many, self.fill = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        self.outs: dict[int, tuple] = {}

    def add(self, items: dict[int, int], many: int) -> None:
        b = Bin(items, many)
        i = self.alive.get(b.key())
        if i is not None:
            if self.many[i] == 1:  # a pattern with two bins or more can also exchange within itself
                self.seen[i] = min(self.seen[i], i)
            self._count(i, many)
            return
        i, m = self.n, len(items) + 1
        while self.size + m > len(self.owner):
            self.owner, self.back, self.reach = (np.concatenate([x, np.zeros_like(x)]) for x in (self.owner, self.back, self.reach))
        if i == len(self.many):
            self.many, self.fill = np.concatenate([self.many, np.zeros_like(self.many)]), np.concatenate([self.fill, np.zeros_like(self.fill)])
        at = slice(self.size, self.size + m)
        self.owner[at], self.back[at] = i, [0, *items]
        self.reach[at] = self.back[at] + self.capacity - b.fill
        self.fill[i] = b.fill
        self.bins.append(Bin(b.items, 0))
        self.seen.append(0)
        self.alive[b.key()] = i
        self.n, self.size = i + 1, self.size + m
        self.start.append(self.size)
        self.many[i] = 0
        self._count(i, many)

    def _count(self, i: int, more: int) -> None:
        b = self.bins[i]
        old, b.many = b.many, b.many + more
        self.many[i] = b.many
        if old.bit_length() != b.many.bit_length():
            if old:
                del self.order[bisect_left(self.order, (-old.bit_length(), b.fill, i))]
            if b.many:
                insort(self.order, (-b.many.bit_length(), b.fill, i))

    def take(self, i: int, many: int) -> None:
        self._count(i, -many)
        if not self.bins[i].many:
            del self.alive[self.bins[i].key()]
            self.outs.pop(i, None)

    def compact(self) -> None:
        """Forget patterns that ran out, once they are most of all."""
        if self.n < 1024 or 2 * len(self.alive) > self.n:
            return
        kept = sorted(self.alive.values())
        old, before = self, np.concatenate([[0], np.cumsum(self.many[: self.n] > 0)])
        fresh = _Underfull(self.capacity)
        for i in kept:
            fresh.add(old.bins[i].items, old.bins[i].many)
        fresh.seen = [int(before[old.seen[i]]) for i in kept]
        self.__dict__.update(fresh.__dict__)

    def _gifts(self, p: int) -> tuple:
        """Sorted sizes of one document, and of one or two, that pattern p can give; which ones the latter are."""
        if p not in self.outs:
            items = self.bins[p].items
            ones = np.sort(np.array(list(items), dtype=np.int64))
            i, j = np.triu_indices(len(ones))
            pair = (i != j) | (np.array([items[n] for n in ones.tolist()])[i] > 1)
            sizes = np.concatenate([(ones[i] + ones[j])[pair], ones])
            first, second = np.concatenate([ones[i][pair], ones]), np.concatenate([ones[j][pair], np.zeros_like(ones)])
            by = np.argsort(sizes, kind="stable")  # of equal sizes the single document is last, and found first
            self.outs[p] = ones, sizes[by], first[by], second[by]
        return self.outs[p]

    def exchange(self, p: int) -> tuple[int, list[int], list[int]] | None:
        """The pattern that gains most by p in all bins that both have, what p gives to it (as much as fits) and what it gives back."""
        lo, hi = self.start[self.seen[p]], self.size
        owner, back, reach = self.owner[lo:hi], self.back[lo:hi], self.reach[lo:hi]
        ones, sizes, first, second = self._gifts(p)
        at = np.searchsorted(sizes, reach, side="right") - 1
        net = np.where(at >= 0, sizes[at], 0) - back
        alone = np.flatnonzero(back == 0)  # two documents for none are two moves
        one = np.searchsorted(ones, reach[alone], side="right") - 1
        net[alone] = np.where(one >= 0, ones[one], 0)
        good = (net > 0) & (self.many[owner] > (owner == p)) & (self.fill[owner] >= self.fill[p])
        if not good.any():
            self.seen[p] = self.n
            return None
        both = np.where(owner == p, self.many[p] // 2, np.minimum(self.many[owner], self.many[p])).astype(np.float64)
        i = int(np.argmax(np.where(good, both * net * (self.fill[owner] - self.fill[p] + net), -1)))
        if back[i] == 0:
            return int(owner[i]), [int(net[i])], []
        given = [int(first[at[i]]), int(second[at[i]])]
        return int(owner[i]), [n for n in given if n], [int(back[i])]


def local_search(bins: list[Bin], capacity: int, counts: dict[int, int], patience: int | None = None) -> list[Bin]:
    """Exchange between underfull bins until the lower bound is met or nothing helps.

    Patterns of many bins come first, of those the emptiest; each gives to the others and to its own like, where it
    gains most, in as many bins at once as both have.
    Any net gift from a bin to one at least as full raises the sum of squared fills, so the search ends by itself;
    `patience` can bound the exchanges, and without it there is no bound.
    """
    least = -(-sum(n * k for n, k in counts.items()) // capacity)
    full = [b for b in bins if b.fill == capacity]
    total = sum(b.many for b in bins)
    under = _Underfull(capacity)
    for b in bins:
        if b.fill < capacity:
            under.add(b.items, b.many)
    while total > least and (patience is None or patience > 0):
        change = None
        for _, _, p in under.order:
            if under.seen[p] < under.n:
                change = under.exchange(p)
                if change:
                    break
        if not change:
            break
        r, out, back = change
        poor, rich = under.bins[p], under.bins[r]
        many = poor.many // 2 if p == r else min(poor.many, rich.many)
        fresh = _moved(poor, out, back), _moved(rich, back, out)
        under.take(p, many)
        under.take(r, many)
        for items in fresh:
            if not items:
                total -= many
            elif sum(n * k for n, k in items.items()) == capacity:
                full.append(Bin(items, many))
            else:
                under.add(items, many)
        under.compact()
        if patience is not None:
            patience -= 1
    return full + [under.bins[i] for _, _, i in under.order]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Places by length and rank: from rank `low` of `length` on, `copies` to a bin from bin `base` on, at `offset`."""
    merged: Counter = Counter()
    for b in local_search(best_fit(counts, capacity), capacity, counts):
        merged[b.key()] += b.many
    rows, used, base = [], Counter(), 0
    for items, many in sorted(merged.items(), reverse=True):
        offset = 0
        for length, copies in items:
            rows.append((length, used[length], base, copies, offset))
            used[length] += copies * many
            offset += copies * length
        base += many
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << _SHIFT) + table[:, 1], "low": table[:, 1], "base": table[:, 2], "copies": table[:, 3], "offset": table[:, 4], "bins": np.array(base)}


def pack(cut: DataFrame, stages: Stages, capacity: int = CAPACITY) -> DataFrame:
    """Rows with `length` (1 to capacity) and their own columns, plus sequence_id and offset."""
    spark = cut.sparkSession
    rows = stages.put(cut.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    ranked = numbered(rows, stages, ["length"], "_uid", "_rank").drop("_uid")
    kept = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            i = np.searchsorted(p["key"], (length.astype(np.int64) << _SHIFT) + rank, side="right") - 1
            j = rank - p["low"][i]
            arrays = [batch.column(c) for c in kept] + [pa.array(p["base"][i] + j // p["copies"][i]), pa.array(p["offset"][i] + j % p["copies"][i] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "packing")
    return pack(pieces(read(spark, sf_dir, "documents", "doc_id", "text")), stages)


QUERIES = {"op3_packing": op3_packing}
ORACLE_SQL: dict[str, str] = {}
