"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are mapped to classes: insults (learned words and stems with weights), threats, targets, negations,
reporting verbs and quotation marks. Small transducers over these classes each know one thing: whether a
negation, a target or a reporting verb stands before, whether a quotation is open, and, read from right to
left, whether a target follows. compose() builds the product of those that read from left to right; a clause
is run through it once in each direction, and an arc that reads an insult or a threat emits its weight as
plain, targeted, negated, reported or threatening, as the product's state and the state ahead decide. The
weight of a clause is the sum over its path; clauses whose path emits nothing are no match and count for
nothing. A text's score is a logistic function of the weights of its matched clauses by kind.

Learning uses labelled rows outside the held-out fifth, of those the SAMPLE with the least hash of doc_id, one
text an id: the documented bound of the classifier's training set. The lexicon is fitted on it as well: of the
CANDIDATES commonest words and stems of toxic texts, the LEXICON surest.

Cases: a null or blank text matches nothing and scores as the bias; repeated rows score alike; without
labels the prior weights stand and the lexicon holds the fixed seeds alone; words of any length are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from amalgam.llm.common import Stages, read

SAMPLE = 20_000
CANDIDATES = 50_000
LEXICON = 4_000
STEMS = (4, 5, 6)
#: Words whose class a task remembers: memory, not a limit on what is read.
REMEMBERED = 100_000
#: For how many words a negation or a target before holds, and how many words ahead a target may follow.
BEHIND, AHEAD = 4, 3
#: A feature joins the lexicon if its log odds of toxicity, less 1.96 standard errors, are at least this.
LEAST_ODDS = 2.0

#: Seeds of each class.
TARGETS = frozenset("you your yours u ur he she they them this that these those du dich dir ihr euch sie tu te toi vous il elle tú ti usted ustedes él ella".split())
NEGATIONS = frozenset("not no never nobody isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca ningún tampoco".split())
REPORTS = frozenset("said says say told wrote writes quoted called reported claims claimed sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
THREATS = frozenset("kill murder hurt stab shoot hang destroy strangle töten umbringen tuer frapper matar golpear".split())
INSULT_SEEDS = frozenset("idiot moron imbecile scumbag".split())

KINDS = ("plain", "targeted", "negated", "reported", "threat")
_OUT = [*[f"_{k}" for k in KINDS], "_score"]
#: Prior mean of each weight, the bias first: what the grammar says before any label is seen.
PRIOR = np.array([-2.5, 2.0, 2.5, 0.8, 0.8, 2.0])
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n\"“”«»]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")


#: Classes of words, and the letter that stands for each.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OTHER = range(7)
_CLASS = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (QUOTE, _QUOTES)) for w in words}


class Transducer:
    """States from 0, the start; arcs[state][class] is the next state, and `holds` the states that say yes."""

    def __init__(self, arcs: list[list[int]], holds: set[int]):
        self.arcs, self.holds = arcs, holds


def within(on: int, reach: int) -> Transducer:
    """Says yes for `reach` words after one of class `on`; quotation marks are no words."""
    step = lambda s, c: reach if c == on else s if c == QUOTE else max(0, s - 1)
    return Transducer([[step(s, c) for c in range(7)] for s in range(reach + 1)], set(range(1, reach + 1)))


def since(on: int) -> Transducer:
    """Says yes from the first word of class `on` to the end of the clause."""
    return Transducer([[int(s or c == on) for c in range(7)] for s in range(2)], {1})


def between(mark: int) -> Transducer:
    """Says yes between an opening and a closing mark."""
    return Transducer([[s ^ (c == mark) for c in range(7)] for s in range(2)], {1})


def compose(machines: list[Transducer]) -> tuple[list[list[int]], list[tuple[bool, ...]], dict[tuple, int]]:
    """The product: arcs, what each machine says in each state, and the number of each state; only what can be reached."""
    number, order, arcs = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    for state in order:  # grows while it is read
        row = []
        for c in range(7):
            after = tuple(m.arcs[s][c] for m, s in zip(machines, state))
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        arcs.append(row)
    return arcs, [tuple(s in m.holds for m, s in zip(machines, state)) for state in order], number


def emitted_as(negated: bool, targeted: bool, reported: bool, quoted: bool, target_ahead: bool) -> tuple[int, int]:
    """The kind as which an insult and a threat are emitted; -1: not at all."""
    if negated:
        return KINDS.index("negated"), KINDS.index("negated")
    if reported or quoted:
        return KINDS.index("reported"), KINDS.index("reported")
    if targeted or target_ahead:
        return KINDS.index("targeted"), KINDS.index("threat")
    return KINDS.index("plain"), -1


_FORWARD, _SAYS, _NUMBER = compose([within(NEGATION, BEHIND), within(TARGET, BEHIND), since(REPORT), between(QUOTE)])
_QUOTED = [says[3] for says in _SAYS]
_OPENED = _NUMBER[(0, 0, 0, 1)]
_BACKWARD = within(TARGET, AHEAD)
_EMIT = [[emitted_as(*says, ahead) for ahead in (False, True)] for says in _SAYS]


def features_of(word: str) -> list[str]:
    """The word itself and its stems, a stem marked by a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


class Grammar:
    """lexicon: word or stem* to weight of an insult."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        import ahocorasick

        self.lexicon, self.weights = lexicon, weights
        self.known: dict[str, tuple[int, float]] = {}
        self.automaton = ahocorasick.Automaton()
        for key in [*lexicon, *THREATS]:
            self.automaton.add_word(key.rstrip("*"), 1)
        self.automaton.make_automaton()

    def insult(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)

    def read(self, token: str) -> tuple[int, float]:
        """Class and weight of a word, remembered for the first words met."""
        found = self.known.get(token)
        if found is None:
            weight = self.insult(token)
            found = (INSULT, weight) if weight > 0 else (_CLASS.get(token, OTHER), 1.0)
            if len(self.known) < REMEMBERED:
                self.known[token] = found
        return found

    def clause(self, tokens: list[str], out: np.ndarray, quoted: bool) -> bool:
        """Run the grammar over a clause and add its path's weights to `out` by kind. Returns whether a quotation is open."""
        read = [self.read(token) for token in tokens]
        classes = [c for c, _ in read]
        if INSULT not in classes and THREAT not in classes:  # no path emits anything; only the quotation matters
            return quoted ^ (classes.count(QUOTE) % 2 == 1)
        ahead, follows = 0, []
        for c in reversed(classes):
            follows.append(ahead in _BACKWARD.holds)
            ahead = _BACKWARD.arcs[ahead][c]
        follows.reverse()
        state = _OPENED if quoted else 0
        for i, c in enumerate(classes):
            if c <= THREAT:
                kind = _EMIT[state][follows[i]][c]
                if kind >= 0:
                    out[kind] += read[i][1]
            state = _FORWARD[state][c]
        return _QUOTED[state]

    def emitted(self, text: str | None) -> np.ndarray:
        """Summed weights by kind, over all clauses of the text that hold a match."""
        out = np.zeros(len(KINDS))
        if not text:
            return out
        low = text.lower()
        if next(self.automaton.iter(low), None) is None:  # nothing that any transducer emits
            return out
        tokens, quoted = [], False
        for token in _TOKEN.findall(low):
            if token in _ENDS:
                quoted = self.clause(tokens, out, quoted) if tokens else quoted
                tokens = []
                if token == "\n":
                    quoted = False
            else:
                tokens.append(token)
        if tokens:
            self.clause(tokens, out, quoted)
        return out

    def score(self, emitted: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(emitted) @ self.weights, -30, 30)))


def design(emitted: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(emitted)), np.log1p(emitted)])


def fit(emitted: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic weights by Newton steps, pulled towards PRIOR; weights of matches never fall below 0."""
    x, w = design(emitted), PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counted(docs: DataFrame, only: set[str] | None) -> DataFrame:
    """feature, n: in how many texts; pre-aggregated by task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for f in frames:
            for text in f["text"]:
                found = {x for w in set(_WORD.findall((text or "").lower())) for x in features_of(w)}
                counts.update(found if only is None else found & only)
        yield pd.DataFrame({"feature": list(counts), "n": list(counts.values())}).astype({"feature": str, "n": "int64"})

    return docs.select("text").mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, stages: Stages, sample: int = SAMPLE, candidates: int = CANDIDATES, most: int = LEXICON) -> Grammar:
    """docs (doc_id, text), labels (doc_id, toxic); learns from at most `sample` ids outside the held-out fifth.

    `candidates` bounds the words and stems that are weighed, the commonest first, and `most` the lexicon.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    chosen = stages.put(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    of_id = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    texts = stages.put(of_id, "texts")
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    lexicon = dict.fromkeys(INSULT_SEEDS, 1.0)
    if n_bad and n_good:
        least = max(3, n_bad // 1000)
        bad = {r["feature"]: r["n"] for r in _counted(texts.where("toxic = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(candidates).collect()}
        names = set(bad)
        good = {r["feature"]: r["n"] for r in _counted(texts.where("toxic = 0"), names).collect()}
        surest = {}
        for f, k in bad.items():
            g = good.get(f, 0)
            odds = np.log((k + 0.5) / (n_bad + 1)) - np.log((g + 0.5) / (n_good + 1))
            surest[f] = odds - 1.96 * np.sqrt(1 / (k + 0.5) + 1 / (g + 0.5))
        best = sorted((f for f, o in surest.items() if o >= LEAST_ODDS), key=lambda f: (-surest[f], f))[:most]
        lexicon |= {f: float(surest[f] / LEAST_ODDS) for f in best}
    grammar = Grammar(lexicon, PRIOR.copy())
    if n_bad and n_good:
        seen = _emissions(texts, ["toxic"], grammar).toPandas()  # at most `sample` rows of a few numbers
        grammar.weights = fit(seen[_OUT[:-1]].to_numpy(), seen["toxic"].to_numpy(float))
    return grammar


def _emissions(docs: DataFrame, keep: list[str], grammar: Grammar) -> DataFrame:
    """`keep`, untouched, then the emitted weights by kind and the score of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*shared.value)
        for batch in batches:
            out = np.array([g.emitted(t.as_py()) for t in batch.column("text")]).reshape(-1, len(KINDS))
            arrays = [batch.column(c) for c in keep] + [pa.array(out[:, i]) for i in range(len(KINDS))] + [pa.array(g.score(out))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *_OUT])

    schema = StructType([*docs.select(*keep).schema.fields, *[StructField(c, DoubleType()) for c in _OUT]])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def scored(docs: DataFrame, grammar: Grammar, keep: list[str], name: str = "score") -> DataFrame:
    """docs (text and `keep`) to `keep` plus the score under `name`, from the text alone."""
    return _emissions(docs, keep, grammar).select(*keep, F.col(_OUT[-1]).alias(name))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "toxicity")
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    grammar = train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"), stages)
    out = scored(docs.withColumn("held_out", held_out()), grammar, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
