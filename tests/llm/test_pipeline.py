import corpus_pipeline
from amalgam.llm import personal_data
from amalgam.llm.common import Stages


def run_stages(spark, path):
    stages, docs, out = Stages(spark, "t"), spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        docs = stages.put(f(spark, docs, path), name.replace(" ", "-"))
        out[name] = docs
    return out


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    out = run_stages(spark, sf)
    names = list(out)
    assert names == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    for name in names[:4]:
        assert out[name].columns == raw.columns and out[name].dtypes == raw.dtypes
    counts = [raw.count(), *[out[n].count() for n in names[:4]]]
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0.4 * counts[3]
    texts = [r.text for r in out["near duplicates"].select("text").collect() if r.text.strip()]
    assert len(texts) == len(set(texts))
    assert not any(personal_data.base_spans(r.text) for r in out["personal data"].select("text").collect())
    assert all(r.n_chars == len(r.text) for r in out["personal data"].collect())
    assert {r[0] for r in out["packing"].select("doc_id").distinct().collect()} == {r[0] for r in out["mixing"].select("doc_id").collect()}


def test_odd_rows(spark, odd_documents, tmp_path):
    import shutil

    shutil.copytree(odd_documents, tmp_path / "x")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/x/labels.parquet")
    out = run_stages(spark, str(tmp_path / "x"))
    kept = out["near duplicates"].collect()
    assert sum((r.text or "").startswith("the same") for r in kept) == 1
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted([(False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (False, 7), (False, 8), (False, 100)])


def test_no_documents(spark, no_documents):
    assert corpus_pipeline.run(spark, no_documents).count() == 0
