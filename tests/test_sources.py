from amalgam.plans.rules import Rule, RuleSet
from amalgam.sources import io
from amalgam.streaming.incremental import match_stream


def test_csv_tokens_and_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text('zip,name\n02139,"O\'Brien, Ann"\nNA,null\n')
    rows = [tuple(r) for r in io.with_row_id(io.load(spark, str(tmp_path / "a.csv"))).orderBy("row_id").collect()]
    assert rows == [(0, "02139", "O'Brien, Ann"), (1, None, None)]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": null}]')
    assert sorted(io.load(spark, str(tmp_path / "a.json")).toPandas().x.fillna(0)) == [0, 1]


def test_fingerprints(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_id long, v string")
    b = spark.createDataFrame([(0, "y"), (1, "x")], "row_id long, v string")
    assert io.fingerprint(a.select("v")) == io.fingerprint(b.select("v"))
    assert io.fingerprint(a, "row_id") != io.fingerprint(b, "row_id")
    assert io.content_hash({"b": 1, "a": 2}) == io.content_hash({"a": 2, "b": 1})


def test_cache(spark, tmp_path):
    cache = io.ResultCache(spark, str(tmp_path / "c"))
    assert cache.get("k") is None
    cache.put("k", {"a": 1})
    assert cache.get("k") == {"a": 1}
    (tmp_path / "c" / "bad.json").write_text("{")
    assert cache.get("bad") is None


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "row_id long, npi string"
    rules = RuleSet([Rule("u", "l", "automatic", exact=("npi",))])
    for i, rows in enumerate(([(0, "a"), (1, "b")], [(2, "a"), (3, "a")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        match_stream(spark.readStream.schema(schema).parquet(str(source)), rules, str(tmp_path / "r"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "p"))
    assert {(r.idx_a, r.idx_b) for r in found.collect()} == {(0, 2), (0, 3), (2, 3)}
