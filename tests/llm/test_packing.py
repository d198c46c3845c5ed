import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from amalgam.llm import packing

SF = "/root/testdata/sf0.001"


def check(spark, path):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.op3_packing(spark, path).toPandas()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").toPandas()
    want = []
    for d, t in zip(docs.doc_id, docs.text):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want.append((-1 if d != d else int(d), k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())))
    got = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    return out


def test_query_against_the_library(spark):
    out = check(spark, SF)
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


def test_odd_rows_and_none(spark, odd_documents, no_documents):
    check(spark, odd_documents)
    assert check(spark, no_documents).empty


def test_tokenizer_on_odd_text():
    from amalgam.llm.tokens import WordTokenizer

    own, library = WordTokenizer(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    odd = ["Don't we'll 'S x's 12a3", "<|endoftext|>a b<|startoftext|>", "é ́x ΣΑΣ σς", "İstanbul ẞ ﬁ Ⱥ ŉ µ ª ×÷ \x1c\x85y\xa0z", "　中文 字 한국 x", "\x00\x01 a\x7fb", "%%%*** the!!", "￿\U0010ffff"]
    odd += ["".join(rng.choice("aZéÉßñ'’.,!$ 09\n\tΣ́​İ中-_<|>") for _ in range(80)) for _ in range(400)]
    for text in odd:
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_local_search_beats_best_fit():
    # best fit of 5, 5, 4, 4, 3, 3, 3, 3 into 10: exchange still has to keep what fits
    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        counts = {n: lengths.count(n) for n in lengths}
        first = packing.best_fit(counts, 60)
        bins = packing.local_search(first, 60, counts)
        back: dict = {}
        for b in bins:
            assert b.fill == sum(n * k for n, k in b.items.items()) <= 60
            for n, k in b.items.items():
                back[n] = back.get(n, 0) + k * b.many
        assert back == counts
        assert sum(b.many for b in bins) <= sum(b.many for b in first)


def test_exchange_empties_a_bin():
    bins = [packing.Bin({6: 1, 3: 1}, 1), packing.Bin({7: 1, 2: 1}, 1), packing.Bin({2: 1}, 1)]
    assert sum(b.many for b in packing.local_search(bins, 10, {6: 1, 3: 1, 7: 1, 2: 2}, 1000)) == 2


def test_exchange_acts_on_all_equal_bins():
    # best fit fills 60,000 bins with 1638 twice and 40,000 with 1228 three times
    counts = {1638: 120_000, 1228: 120_000}
    first = packing.best_fit(counts, 4096)
    assert sum(b.many for b in first) == 100_000
    bins = packing.local_search(first, 4096, counts)
    assert sum(b.many for b in bins) == 90_000
    assert all(sum(b.items.get(n, 0) * b.many for b in bins) == k for n, k in counts.items())


def test_search_ends_only_when_nothing_helps():
    rng = random.Random(6)
    for _ in range(60):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(9, 60), rng.randint(1, 8))}
        bins = packing.local_search(packing.best_fit(counts, 60), 60, counts)
        if sum(b.many for b in bins) == -(-sum(n * k for n, k in counts.items()) // 60):
            continue
        each = [b for b in bins for _ in range(min(b.many, 2)) if b.fill < 60]
        for i, poor in enumerate(each):
            docs = [n for n, k in poor.items.items() for _ in range(k)]
            twos = {docs[x] + docs[y] for x in range(len(docs)) for y in range(x)}
            for j, rich in enumerate(each):
                if i == j or rich.fill < poor.fill:
                    continue
                nets = {n - back for n in docs for back in (0, *rich.items)} | {t - back for t in twos for back in rich.items}
                assert not any(0 < n <= 60 - rich.fill for n in nets), (poor.items, rich.items)


def test_search_packs_from_an_underfull_start():
    """One length a bin to begin with: moves and exchanges alone empty a sixth of the bins, if not as many as best fit saves."""
    import random

    from amalgam.llm.packing import Bin, local_search

    rng = random.Random(4)
    counts = {rng.randint(20, 900): rng.randint(1, 40) for _ in range(40)}
    capacity = 1000
    start = []
    for n, k in counts.items():
        each = capacity // n
        start += [Bin({n: each}, k // each)] if k // each else []
        start += [Bin({n: k % each}, 1)] if k % each else []
    out = local_search(start, capacity, counts)
    got: dict[int, int] = {}
    for b in out:
        assert 0 < b.fill <= capacity
        for n, k in b.items.items():
            got[n] = got.get(n, 0) + k * b.many
    assert got == counts
    assert sum(b.many for b in out) <= 5 / 6 * sum(b.many for b in start)
    squares = lambda bins: sum(b.many * b.fill**2 for b in bins)
    assert squares(out) > squares(start)
