import zlib

from amalgam.llm import sharding
from amalgam.llm.common import Stages

SF = "/root/testdata/sf0.01"


def check(spark, path):
    out = sharding.op1_sharding(spark, path).toPandas()
    docs = spark.read.parquet(f"{path}/documents.parquet").toPandas()
    want = sorted((-1 if d != d else int(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in zip(docs.doc_id, docs.text))
    assert sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.size_, r.text_crc32) for r in out.rename(columns={"size": "size_"}).itertuples()) == want
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert out.shard.between(0, 39).all() and out.grown_shard.isna().all()
    return out


def test_sizes_are_near_equal(spark):
    out = check(spark, SF)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 40
    assert (sizes - out["size"].sum() / 40).abs().max() <= out["size"].max()


def test_odd_rows_and_none(spark, odd_documents, no_documents):
    check(spark, odd_documents)
    assert sharding.op1_sharding(spark, no_documents).count() == 0


def test_a_value_that_most_rows_share_is_cut(spark):
    rows = spark.range(0, 3000, 1, 5).selectExpr("id as doc_id", "10L as size", "0L as text_crc32", "0D as doc", "1D as length", "CAST(id % 3 = 0 AS double) as lang", "5D as source")
    out = sharding.kd_shards(rows, Stages(spark, "t"), target_bytes=3000).groupBy("shard").agg({"size": "sum"}).toPandas()
    assert len(out) == 10 and out["sum(size)"].between(2990, 3010).all()


def test_leaves_are_boxes(spark):
    """Two shards of a table whose widest dimension is the length: every row below is no longer than any above."""
    rows = spark.range(0, 1000, 1, 3).selectExpr("id as doc_id", "1L + id % 7 as size", "0L as text_crc32", "1D as doc", "CAST(id * 37 % 1000 AS double) as length", "0D as lang", "0D as source")
    out = sharding.kd_shards(rows, Stages(spark, "t"), shards=2).toPandas()
    assert out[out.shard == 0].length.max() <= out[out.shard == 1].length.min()


def test_shards_against_brute_force(spark):
    """Every cut by hand: the widest dimension, rows in order of value and row, the prefix nearest to its share of bytes."""
    import random

    rng = random.Random(9)
    rows = [(i, rng.randint(1, 400), float(rng.randint(0, 50)), float(rng.choice([1, 1, 1, 2, 5])), float(rng.randint(0, 9)), 0.0) for i in range(300)]
    columns = ["doc", "length", "lang", "source"]
    df = spark.createDataFrame([(i, s, 0, *d) for i, s, *d in rows], "doc_id long, size long, text_crc32 long, doc double, length double, lang double, source double")
    out = sharding.kd_shards(df, Stages(spark, "t"), shards=11).toPandas()
    place = {r.uid: r for r in out.itertuples()}
    extent = lambda uids, c: max(getattr(place[u], c) for u in uids) - min(getattr(place[u], c) for u in uids)
    whole = {c: extent(place, c) for c in columns}
    weight = {u: int(out["size"][i]) for i, u in zip(out.index, out.uid)}
    want = {}

    def cut(uids, k, first):
        if k == 1:
            want.update(dict.fromkeys(uids, first))
            return
        widest = max(range(4), key=lambda i: (extent(uids, columns[i]) / whole[columns[i]] if whole[columns[i]] else 0, -i))
        order = sorted(uids, key=lambda u: (getattr(place[u], columns[widest]), u))
        goal, total, best = sum(weight[u] for u in uids) * (k // 2) / k, 0, []
        for i, u in enumerate(order):
            total += weight[u]
            best.append((abs(total - goal), i))
        at = min(best)[1] + 1
        cut(order[:at], k // 2, first)
        cut(order[at:], k - k // 2, first + k // 2)

    cut(list(place), 11, 0)
    assert {u: r.shard for u, r in place.items()} == want


def test_text_places_are_ranks_of_whole_values(spark):
    values = [None, "", "a", "prefix-longer-than-six-1", "prefix-longer-than-six-2", "prefix-longer-than-six-10", "é", "prefix"]
    df = spark.createDataFrame([(i, "x", v, v) for i, v in enumerate(values)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.lang, r.source) for r in sharding.described(df, Stages(spark, "t")).collect()}
    order = sorted({v or "" for v in values}, key=lambda v: v.encode())
    assert got == {i: (order.index(v or "") + 1.0,) * 2 for i, v in enumerate(values)}
