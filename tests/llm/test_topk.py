import numpy as np
import pytest

from amalgam.llm import topk
from amalgam.llm.common import Stages

SF = "/root/testdata/sf0.01"


def brute(ids, x, every, k):
    out = set()
    for i, v in enumerate(ids):
        if v % every == 0:
            s = x @ x[i]
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j], j))[:k]
            out |= {(int(v), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    return out


def rows(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_query_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(e.embedding).astype(float))
    assert rows(topk.op10_topk(spark, SF)) == brute(e.vec_id.to_numpy(), x, 50, 5)


@pytest.mark.parametrize("shard_rows", [16_384, 60])
def test_ties_and_shards(spark, shard_rows):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (400, 3)).astype(float)
    x[100:250] = x[0]  # a third of the rows are copies
    ids = rng.permutation(400)
    points = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, vector array<double>")
    from pyspark.sql import functions as F

    out = topk.exact_topk(points, Stages(spark, "t"), F.col("id") % 10 == 0, 5, shard_rows).withColumnRenamed("id", "vec_id")
    assert rows(out) == brute(ids, x, 10, 5)


def test_odd_vectors_and_none(spark, no_documents, tmp_path):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (100, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])]
    spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op10_topk(spark, str(tmp_path)).collect())
    assert [g[:3] for g in got] == [(0, 1, 4), (0, 2, 4), (0, 3, 50), (50, 1, 0), (50, 2, 4), (50, 3, 4)]
    assert topk.op10_topk(spark, no_documents).count() == 0


def test_large_whole_numbers_are_exact(spark, tmp_path):
    """Products beyond 2**53 differ in their last digits; beyond long they are given as its bound, in exact order."""
    big = float(1 << 22)
    data = [(0, [big, 1.0]), (1, [big * 4, 1.0]), (2, [big * 4, 2.0]), (3, [big * 4, 3.0]), (4, [-big * 4, 0.0]), (50, [2.0**40, 0.0]), (51, [2.0**60, 0.5]), (52, [2.0**60, -0.5])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {i: [int(np.floor(256 * np.float64(np.float32(a)))) for a in v] for i, v in data}
    want = set()
    for q in (0, 50):
        score = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        want |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, score[i]))) for r, i in enumerate(best)}
    assert rows(topk.op10_topk(spark, str(tmp_path))) == want


def test_bounds_spare_shards(spark):
    """Near-by vectors share a shard, and a query is not sent to shards that its k-th score rules out."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(32, 6)) * 40
    x = np.round(centres[np.arange(3200) % 32] + rng.normal(size=(3200, 6)))
    points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    from pyspark.sql import functions as F

    stages = Stages(spark, "t")
    sent, put = [], stages.put
    stages.put = lambda df, name, *a: (sent.append(out) if name.startswith("reached") else None, out)[1] if (out := put(df, name, *a)) is not None else None
    got = topk.exact_topk(points, stages, F.col("id") % 10 == 0, 5, 100).withColumnRenamed("id", "vec_id")
    assert rows(got) == brute(np.arange(3200), x, 10, 5)
    assert len(sent) == 3 and sent[0].count() == 320
    assert sum(df.count() for df in sent) < 0.6 * 320 * 32
