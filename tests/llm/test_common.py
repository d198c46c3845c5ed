import random

from pyspark.sql import functions as F

from amalgam.llm.common import Stages, components, fresh, key_filter, numbered, words


def test_words():
    assert words(" a\tb c\x0b\x1cd \n") == ["a", "b c", "\x1cd"]
    assert words(None) == words(" \n") == []
    assert words("a  b") == ["a", "b"]


def test_numbers_are_gapless(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id AS uid", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 = 0 THEN NULL ELSE 'b' END AS g")
    out = numbered(rows, Stages(spark, "t"), ["g"], "uid", "n", block=100).toPandas()
    for _, part in out.fillna({"g": "?"}).groupby("g"):
        assert sorted(part.n) == list(range(len(part)))


def test_components_of_a_long_chain(spark):
    order = list(range(150))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (200, 201)], "a long, b long")
    got = {r.v: r.c for r in components(edges, Stages(spark, "t"), limit=14).collect()}
    assert got == {**{i: 0 for i in range(150)}, 200: 200, 201: 200}
    assert components(edges.where(F.lit(False)), Stages(spark, "t")).count() == 0


def test_key_filter_holds_no_key_back(spark):
    stages = Stages(spark, "t")
    keys = stages.put(spark.range(3000).selectExpr("xxhash64(id) AS k"), "keys")
    every = spark.range(12_000).selectExpr("id", "xxhash64(id) AS k")
    for bits, most in ((1 << 26, 200), (1 << 10, 9_000)):  # a filter that is too small lets more through
        got = {r.id for r in every.where(key_filter(keys, bits)("k")).collect()}
        assert set(range(3000)) <= got and len(got) - 3000 <= most
    assert every.where(key_filter(stages.put(keys.limit(0), "none"))("k")).count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "score int, _Score int")
    assert fresh(df, "score") == "__score" and fresh(df, "other") == "other"
