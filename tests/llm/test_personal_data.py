import hashlib
import random
import re

import pytest

from amalgam.llm import personal_data as P

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The patterns as they are written, then the tests on each match."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def check(spark, path):
    got = P.op4_personal_data(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    want = []
    for d, text in docs:
        base = brute(text)
        want.append((d, *[sum(k == n for n, _, _ in base) for k in P.KINDS], hashlib.sha256(P.join_spans(base).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    return got


def test_query_against_brute_force(spark):
    got = check(spark, SF)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert {P.join_spans([s]) for s in brute(docs[r.doc_id])} <= set(spans)


def test_odd_rows_and_none(spark, odd_documents, no_documents):
    check(spark, odd_documents)
    assert P.op4_personal_data(spark, no_documents).count() == 0


def test_patterns_on_noise():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("ab@@..-+%_ 0123456789()é\n") for _ in range(rng.randint(0, 70)))
        assert P.base_spans(text) == brute(text), text
    for text in ("a@b.c._d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.4", "4111-1111 1111 1111 4111111111111111", "+1 (555) 555-1234 +12", "x@y.com.z@w.com", "a@b@c.d"):
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_no_longer():
    import time

    began = time.time()
    P.base_spans("a" * 300_000 + " " + "1" * 300_000 + " +" + "." * 300_000 + "@" * 1000)
    assert time.time() - began < 10


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, f"some words here {phone} and then more of {rng.randint(1, 99)} words in {rng.randint(1900, 2020)}"))
    from amalgam.llm.common import Stages

    return P.train(spark.createDataFrame(rows, "doc_id long, text string"), Stages(spark, "t"))


def test_field_adds_what_the_patterns_drop_and_leaves_numbers_alone(field):
    # the digits that follow make the phone pattern's match too long, so it is dropped
    text = "call +1 (455) 555-1234 00000000 now"
    assert not any(k == "phone" for k, _, _ in P.base_spans(text))
    assert any(k == "phone" and s == 5 for k, s, _ in field.spans(text))
    assert field.spans("in 1984 we had 42 of them") == []


def test_skip_edges_agree(field):
    """A token alone that the field doubts follows its likes elsewhere in the document."""
    a = P.tokens("x 555-9999 y 555-9999 z 555-9999")
    chain, skip = P._edges(a)
    assert chain == [] and skip == [(0, 1), (1, 2)]
    many = P.tokens(" ".join(["555-9999 w"] * 3000))
    assert len(P._edges(many)[1]) == 2999
    assert field.beliefs(many).shape == (3000, 5)


def test_skip_edges_beside_a_chain_elsewhere():
    """A chain edge in one place takes no skip edge away in another; it stands for the skip edge of its own pair only."""
    far = " plain words" * 250
    chain, skip = P._edges(P.tokens(f"5 10 then 555-9999{far} 555-9999{far} 555-9999"))
    assert chain == [(0, 1)] and skip == [(2, 3), (3, 4)]
    chain, skip = P._edges(P.tokens("555-9999 555-9999 and 555-9999"))
    assert chain == [(0, 1)] and skip == [(1, 2)]


def test_redaction():
    assert P.redact("a b@c.de f 1.2.3.4", [("email", 2, 8), ("ip", 11, 18)]) == "a <EMAIL> f <IP>"


def enumerated(field, ts):
    """Exact marginals: every labelling of the tokens, weighed."""
    import itertools

    import numpy as np

    chain, skip = P._edges(ts)
    unary = [sum((field.unary[field.names[f]] for f in t.features if f in field.names), np.zeros(5)) for t in ts]
    out = np.zeros((len(ts), 5))
    for labels in itertools.product(range(5), repeat=len(ts)):
        score = sum(u[y] for u, y in zip(unary, labels)) + sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("loops", [False, True])
def test_beliefs_against_enumeration(loops):
    import numpy as np

    rng = np.random.default_rng(6)
    texts = ("1 22 333 4444 5", "7 x 7 y 7", "12 13 x 12 z") if not loops else ("1 2 x 1 2", "5 6 7 x 5 6 7")
    for text in texts:
        ts = P.tokens(text)
        names = {f: i for i, f in enumerate(sorted({f for t in ts for f in t.features}))}
        skip = rng.normal(size=(5, 5)) * (0.4 if loops else 1)
        field = P.Field(names, rng.normal(size=(len(names), 5)) * 0.3, rng.normal(size=(5, 5)) * (0.4 if loops else 1), skip + skip.T)
        got, want = field.beliefs(ts), enumerated(field, ts)
        assert np.abs(got - want).max() < (0.08 if loops else 0.01), (text, got, want)


def test_repeats_pull_a_doubtful_token_along(field):
    import numpy as np

    agree = P.Field(field.names, field.unary, field.chain, np.eye(5) * 2)
    text = "phone +1 (455) 555-1234 and later" + " words" * 500 + " 555-1234 once more 555-1234"
    ts = P.tokens(text)
    alone, linked = P.Field(field.names, field.unary, field.chain, np.zeros((5, 5))).beliefs(ts), agree.beliefs(ts)
    last = [i for i, t in enumerate(ts) if t.core == "555-1234"]
    assert np.ptp(linked[last].argmax(axis=1)) == 0
    top = alone[last].mean(axis=0).argmax()
    assert linked[last][:, top].min() >= alone[last][:, top].min()


def test_training_reads_whole_texts_and_repeats_once(spark):
    """A kind that stands after thousands of other tokens teaches the field, however often another row is repeated."""
    from amalgam.llm.common import Stages

    rng = random.Random(2)
    late = [(i, " ".join(str(rng.randint(10, 99)) for _ in range(400)) + f" write to u{i}@mail.example") for i in range(30)]
    same = [(1000, "call +1 (455) 555-1234 now")] * 500
    field = P.train(spark.createDataFrame(late + same, "doc_id long, text string"), Stages(spark, "t"), sample=40)
    assert any(f.startswith("at 1") for f in field.names)
    assert field.beliefs(P.tokens("ask u7@mail.example"))[0].argmax() == P.LABELS.index("email")
    assert P.tokens("a" + "1b" * 40 + " x")[0].key != P.tokens("a" + "1b" * 40 + "1c x")[0].key
