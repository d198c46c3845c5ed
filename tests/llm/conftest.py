import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string"


@pytest.fixture(scope="session")
def odd_documents(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Some plain words, not many.", None, None, 5), (3, "Some plain words, not many.", None, None, 5),
        (4, long, "de", "b", 7), (5, "Some plain words, not many.", "fr", "b", None), (None, "no id here\x1cat all", "en", "a", 3), (7, " \t\n ", "en", "a", 3),
        (8, "password=abcdef0123456789abcdef01 and a@b.co 10.0.0.1 +1 (555) 555-1234 4111 1111 1111 1111 ünïcödé \U0001f600 x@y.zz", "en", "a", 1),
        *[(100 + i, "the same " + " ".join(f"w{j}" for j in range(70)), "en", "hot", 1) for i in range(12)],
    ]
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.fixture(scope="session")
def no_documents(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)
