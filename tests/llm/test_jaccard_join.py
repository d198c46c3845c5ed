import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import jaccard_join
from amalgam.llm.common import Stages, words


def shingle_set(text):
    ws = words((text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(docs):
    """(doc, class, links) of each row, by comparing every pair that shares a shingle."""
    sets = [shingle_set(t) for _, t in docs]
    ids = [1 << 63 if d is None else d for d, _ in docs]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(docs)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j != i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 64)
    for i in range(len(docs)):
        least[find(i)] = min(least[find(i)], ids[i])
    name = lambda d: -1 if d == 1 << 63 else d
    return sorted((name(ids[i]), name(least[find(i)]), links[i]) for i in range(len(docs)))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in df.collect())


def docs_of(spark, path):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute(docs_of(spark, sf))
    assert got(jaccard_join.op2_jaccard_join(spark, sf)) == want
    assert sum(w[2] > 0 for w in want) > 50


def test_odd_rows_and_none(spark, odd_documents, no_documents):
    assert got(jaccard_join.op2_jaccard_join(spark, odd_documents)) == brute(docs_of(spark, odd_documents))
    assert jaccard_join.op2_jaccard_join(spark, no_documents).count() == 0


@pytest.mark.parametrize(("bucket", "block"), [(2000, 1500), (8, 20)])
def test_one_large_group_of_near_copies(spark, bucket, block):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(150)] = f"e{rng.randrange(9)}"
        docs.append((i, " ".join(ws)))
    docs += [(200 + i, " ".join(f"u{rng.random()}" for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = jaccard_join.jaccard_classes(df, Stages(spark, "t"), bucket=bucket, block_sets=block)
    assert got(out) == brute(docs)


def test_short_texts_are_one_shingle(spark):
    docs = [(1, "A b"), (2, "a  B"), (3, "a b c"), (4, "a"), (5, None), (6, " ")]
    assert got(jaccard_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), Stages(spark, "t"))) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0)]


def test_pairs_in_split_buckets_are_found(spark):
    """Pairs at 0.8 inside a family whose members share a passage and are otherwise apart."""
    rng = np.random.default_rng(5)
    hot, rows, n = rng.integers(1, 1 << 63, 130, dtype=np.uint64), [], 800
    for i in range(n):
        pair = rng.integers(1, 1 << 63, 90, dtype=np.uint64)
        for side in (0, 1):
            own = rng.integers(1, 1 << 63, 27, dtype=np.uint64)
            m = jaccard_join.minima(np.unique(np.concatenate([hot, pair, own])))
            rows.append((2 * i + side, m.tobytes(), (m & 255).astype(np.uint8).tobytes()))
    sets = spark.createDataFrame(rows, "key long, minima binary, sketch binary")
    edges = jaccard_join.candidates(sets, Stages(spark, "t"), recall=0.99, bucket=20)
    root = list(range(2 * n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges.collect():
        a, b = find(e.a), find(e.b)
        root[max(a, b)] = min(a, b)
    assert sum(find(2 * i) == find(2 * i + 1) for i in range(n)) >= 0.99 * n
    assert len({find(i) for i in range(2 * n)}) > 0.8 * n


def test_runs_grow_with_depth():
    assert jaccard_join.survival(0.8, 0.8, 1) == pytest.approx(0.8) and jaccard_join.survival(0.8, 0.8, 2) == pytest.approx(0.8 * 0.84)
    needed = [jaccard_join.runs_needed(0.8, 0.99999, d) for d in range(1, 11)]
    assert needed[0] >= 8 and needed == sorted(needed) and needed[-1] > 26
