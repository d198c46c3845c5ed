import duckdb
import pytest

from amalgam.llm import mixing
from amalgam.llm.common import Stages

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.ORACLE_SQL["op7_mixing"]).fetchall()
    got = mixing.op7_mixing(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_odd_rows_and_none(spark, odd_documents, no_documents):
    got = mixing.op7_mixing(spark, odd_documents).collect()
    assert len(got) == spark.read.parquet(f"{odd_documents}/documents.parquet").count()
    assert all(0 <= r.probability <= 1 for r in got)
    assert mixing.op7_mixing(spark, no_documents).count() == 0


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 900), ("a", "y", "t", 50), ("b", "x", "t", 30), ("b", "y", "u", 20), ("b", "x", "u", 5), ("a", "y", "u", 7)], "source string, lang string, topic string, tokens long")
    target = lambda d, pairs: spark.createDataFrame(pairs, f"{d} string, target double")
    targets = {"source": target("source", [("a", 0.5), ("b", 0.5)]), "lang": target("lang", [("x", 0.6), ("y", 0.4)]), "topic": target("topic", [("t", 0.7), ("u", 0.3)])}
    out = mixing.rake(cells, targets, Stages(spark, "t"))  # ten rounds leave a miss of over 1e-6, so there are more
    for d, t in targets.items():
        got = {r[0]: r[1] for r in out.groupBy(d).agg({"w": "sum"}).collect()}
        assert got == pytest.approx({r[0]: r[1] for r in t.collect()}, abs=2e-6)


def test_expected_tokens_meet_the_budget(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 9) END AS source", "concat('l', id % 2) AS lang", "concat('t', id % 5 % 2) AS topic", "10L + id % 7 AS n_tokens")
    got = mixing.mix(docs, mixing.probabilities(docs, Stages(spark, "t"))).toPandas()
    assert (got.n_tokens * got.probability).sum() == pytest.approx(0.6 * got.n_tokens.sum(), rel=1e-3)
    assert abs(got.n_tokens[got.sampled].sum() / got.n_tokens.sum() - 0.6) < 0.04


def test_blank_texts_always_stay(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    blank = raw.limit(20).selectExpr("doc_id + 10000000 AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN '' END AS text", "'en' AS lang", "source", "n_chars")
    raw.unionByName(blank).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_mixing(spark, str(tmp_path))
    rows = got.where("n_tokens = 0").collect()
    assert len(rows) >= 20 and all(r.sampled and r.weight == r.probability == 1 for r in rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(mixing.ORACLE_SQL["op7_mixing"]).fetchall())


def test_rows_without_an_id_draw_apart(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source", "'l' AS lang", "'t' AS topic", "10L + id AS n_tokens")
    kept = mixing.mix(docs, mixing.probabilities(docs, Stages(spark, "t"))).where("sampled").count()
    assert 160 < kept < 320


def test_targets_that_cannot_be_met_are_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 15)
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    target = lambda d, pairs: spark.createDataFrame(pairs, f"{d} string, target double")
    targets = {"source": target("source", [("a", 0.9), ("b", 0.1)]), "lang": target("lang", [("x", 0.5), ("y", 0.5)]), "topic": target("topic", [("t", 1.0)])}
    with pytest.warns(UserWarning, match="misses its target"):
        assert mixing.rake(cells, targets, Stages(spark, "t")).count() == 2
