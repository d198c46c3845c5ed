import hashlib

import pytest

from amalgam.llm import substrings
from amalgam.llm.common import Stages, words


def brute(docs, window=50):
    """(doc, n_words, n_removed, sha) per row; docs is a list of (doc_id or None, text)."""
    first: dict = {}
    big = 1 << 63
    cut = [(big if d is None else d, words(t)) for d, t in docs]
    for d, ws in cut:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            first[w] = min(first.get(w, big), d)
    out = []
    for d, ws in cut:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((-1 if d == big else d, len(ws), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def docs_of(spark, path):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("group", [4000, 1])
def test_query_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substrings.repeats, "__defaults__", (50, group))
    sf = "/root/testdata/sf0.01"
    want = brute(docs_of(spark, sf))
    assert got(substrings.op5_substrings(spark, sf)) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_odd_rows_and_none(spark, odd_documents, no_documents):
    assert got(substrings.op5_substrings(spark, odd_documents)) == brute(docs_of(spark, odd_documents))
    assert substrings.op5_substrings(spark, no_documents).count() == 0


def test_overlaps_and_low_entropy(spark, tmp_path):
    a = " ".join(f"a{i}" for i in range(120))
    ws = a.split()
    rows = [(5, a), (3, " ".join(ws[30:95])), (9, "x " * 30 + " ".join(ws[10:70]) + " y" * 20), (2, "z " * 200), (8, "q " + "z " * 120), (1, " ".join(ws[:49])), (6, " ".join(ws[20:69] + ["other"] + ws[70:]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(substrings.op5_substrings(spark, str(tmp_path))) == brute(rows)


def test_trees_against_equal_windows():
    """The two inner nodes of a window are the same for two windows just if all their words are."""
    import random

    rng = random.Random(11)
    for _ in range(300):
        window, gram = rng.choice([(6, 2), (8, 3), (5, 1)])
        middle = [rng.choice("ab") for _ in range(gram)]
        contexts, leads = [], []
        for _ in range(rng.randint(1, 12)):
            lead = rng.randint(0, window - gram)
            n = rng.randint(1, lead + 1)
            ws = [rng.choice("ab") for _ in range(n + window - 1)]
            ws[lead : lead + gram] = middle
            contexts.append(" ".join(ws))
            leads.append(lead)
        owners = [rng.randint(0, 9) for _ in contexts]
        first: dict = {}
        windows = [[tuple(c.split()[j : j + window]) for j in range(len(c.split()) - window + 1)] for c in contexts]
        for c, own in enumerate(windows):
            for j, w in enumerate(own):
                key = (leads[c] - j, w)
                first[key] = min(first.get(key, 99), owners[c])
        assert substrings.subtree(contexts, leads, owners, window) == [[first[(leads[c] - j, w)] for j, w in enumerate(own)] for c, own in enumerate(windows)]
