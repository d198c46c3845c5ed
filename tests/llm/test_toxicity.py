import zlib

import numpy as np
import pytest

from amalgam.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = T.op9_toxicity(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit >= 0.85 * (held.toxic == 1).sum()
    assert hit >= 0.9 * held.predicted.sum()


def test_odd_rows_and_none(spark, odd_documents, no_documents, tmp_path):
    import shutil

    shutil.copytree(odd_documents, tmp_path / "x")
    spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/x/labels.parquet")
    got = T.op9_toxicity(spark, str(tmp_path / "x")).collect()
    assert len(got) == spark.read.parquet(f"{odd_documents}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert T.op9_toxicity(spark, no_documents).count() == 0


@pytest.fixture(scope="module")
def grammar():
    return T.Grammar({"idiot": 1.0, "moro*": 1.0}, T.PRIOR.copy())


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("what an idiot", "plain"), ("you are an idiot", "targeted"), ("idiot , yes , you", "targeted"), ("he is not an idiot", "negated"), ("she said idiot", "reported"),
        ('the word "idiot" here', "reported"), ("i will kill you", "threat"), ("morons everywhere", "plain"),
    ],
)
def test_transducers(grammar, text, kind):
    out = dict(zip(T.KINDS, grammar.emitted(text)))
    assert out.pop(kind) > 0 and not any(out.values())


def test_words_outside_patterns_count_for_nothing(grammar):
    assert not grammar.emitted("kill the process. not you. she said so").any()
    assert not grammar.emitted(None).any() and not grammar.emitted("").any()
    alone = grammar.score(np.array([grammar.emitted("idiot idiot idiot")]))
    negated = grammar.score(np.array([grammar.emitted("not idiot. never idiot")]))
    assert alone > 0.5 > negated


def by_hand(classes, quoted):
    """What each insult (i) and threat (h) of a clause is, from the words around it alone."""
    out = []
    for at, c in enumerate(classes):
        if c not in "ih":
            continue
        before = [x for x in classes[:at] if x != "q"]
        after = [x for x in classes[at + 1 :] if x != "q"]
        is_open = (classes[:at].count("q") + quoted) % 2 == 1
        if "n" in before[-4:]:
            out.append("negated")
        elif "r" in before or is_open:
            out.append("reported")
        elif "t" in before[-4:] or "t" in after[:3]:
            out.append("targeted" if c == "i" else "threat")
        elif c == "i":
            out.append("plain")
    return out


def test_grammar_against_definition(grammar):
    import random

    words = {"i": "idiot", "h": "kill", "t": "you", "n": "not", "r": "said", "q": '"', "o": "table"}
    rng = random.Random(1)
    for _ in range(3000):
        classes = [rng.choice("ihtnrqooo") for _ in range(rng.randint(0, 14))]
        quoted, out = rng.random() < 0.3, np.zeros(len(T.KINDS))
        still = grammar.clause([words[c] for c in classes], out, quoted)
        want = by_hand(classes, quoted)
        assert out.tolist() == [want.count(k) for k in T.KINDS], classes
        assert still == ((classes.count("q") + quoted) % 2 == 1)


def test_composition_is_the_product():
    arcs, says, number = T.compose([T.within(T.NEGATION, 2), T.between(T.QUOTE)])
    assert len(arcs) == len(says) == len(number) == 6
    a, b = T.within(T.NEGATION, 2), T.between(T.QUOTE)
    for (x, y), i in number.items():
        assert says[i] == (x in a.holds, y in b.holds)
        assert arcs[i] == [number[(a.arcs[x][c], b.arcs[y][c])] for c in range(7)]
