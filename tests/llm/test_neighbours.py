import numpy as np
from pyspark.sql import functions as F

from amalgam.llm import neighbours as N
from amalgam.llm.common import Stages


def recall(spark, path, every=20, k=20):
    got = N.op6_neighbours(spark, path).toPandas()
    e = spark.read.parquet(f"{path}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hits = []
    for q, g in got.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        s = x @ x[i]
        s[i] = -9
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, k + 1)) and len(set(g.vec_id)) == k
        at = np.searchsorted(ids, g.vec_id)
        assert np.allclose(g.score, s[at], atol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        hits.append(len(set(ids[np.lexsort((ids, -s))[:k]]) & set(g.vec_id)) / k)
    assert len(hits) == (ids % every == 0).sum()
    return np.mean(hits)


def test_recall(spark):
    assert recall(spark, "/root/testdata/sf0.01") >= 0.99
    assert recall(spark, "/root/testdata/sf0.1") >= 0.95


def test_copies_odd_vectors_and_none(spark, no_documents, tmp_path):
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(0, 200)] + [(200 + i, [0.0, float(i % 5) - 2, 1.0]) for i in range(200)] + [(1000, None), (1020, [nan, 1.0, 0.0]), (1040, [0.0, 0.0, 0.0]), (1060, [None, 1.0, 0.0])]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = N.op6_neighbours(spark, str(tmp_path)).toPandas()
    assert set(got.query_id) == {i for i in range(0, 400) if i % 20 == 0}
    for q in (0, 100):  # 199 copies of the query: the smallest ids win
        want = [i for i in range(22) if i != q][:20]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want
    assert N.op6_neighbours(spark, no_documents).count() == 0


def test_recall_over_many_blocks(spark):
    """All queries divisible by 100 of vectors without any blocks of their own: 16 dimensions, 60 blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16)).astype(np.float32).astype(float)
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    got = N.nearest(points, Stages(spark, "t"), F.col("id") % 100 == 0, k=20, block=128).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20]) & set(g.id)) / 20)
    assert len(hits) == 60 and np.mean(hits) >= 0.95, np.mean(hits)


def test_rows_without_an_id_are_candidates(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0]), (None, [2.0, 0.0]), (1, [1.0, 1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    got = N.nearest(points, Stages(spark, "t"), F.col("id") % 20 == 0, k=4).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(0, None, 2.0), (0, 1, 1.0), (0, 2, 1.0), (0, None, 1.0)]


def test_lengths_differ(spark):
    """Inner product favours long vectors; several blocks exchange messages."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.2, 3, size=(900, 1))
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    got = N.nearest(points, Stages(spark, "t"), F.col("id") % 30 == 0, k=10, block=128).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:10]) & set(g.id)) / 10)
    assert len(hits) == 30 and np.mean(hits) >= 0.9
