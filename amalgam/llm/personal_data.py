"""Personal data: patterns of fixed form, and a skip-chain conditional random field on top.

The base spans come from patterns alone. The field labels the tokens that hold a digit or an at sign (any
other token is O with certainty, so chains end there): unary potentials on a token's shape, potentials
between direct neighbours, and skip edges that join each token to the next one that is equal, or similar
in shape with at least seven digits. Loopy sum-product messages make labels agree over the document; a
token with enough belief becomes a span unless a base span holds it. Skip edges join each occurrence to
the next only, so a token that repeats n times costs n edges.

Unary and pair potentials are fitted together, by pseudo-likelihood with the base spans as teacher, on the
whole texts of at most SAMPLE documents: those with the least hash, repeated rows once. Tokens that are alike
in features, label and neighbours' labels are one example with a count; EXAMPLES bounds how many of these the
driver takes, those with the least hash.

Cases: a null text is empty; repeated rows give repeated results; without any base span in the sample
the field adds nothing; a text of any length is read whole, in training and in use.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, read

SAMPLE = 5_000
EXAMPLES = 50_000
BELIEF = 0.95
#: Rounds of messages at most, and the change of a message below which they end.
ROUNDS = 60
SETTLED = 1e-3
#: Bound on each log potential of a pair of labels.
MOST_AGREEMENT = 2.0
LABELS = ("O", "email", "ip", "card", "phone")
KINDS = LABELS[1:]

# The base patterns, in forms that take time in proportion to the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_STRIP = "()[]{}<>\"'`,.;:!?*%$&#|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: an at sign with a domain, and all of the local part before it that is still free."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not text or not _DIGIT_OR_AT.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


class Token:
    __slots__ = ("core", "end", "features", "key", "start", "token_end", "token_start")


def _shape(s: str) -> str:
    return re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", s))


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    for m in _TOKEN.finditer(text):
        raw = m.group()
        core = raw.strip(_STRIP)
        t = Token()
        lead = len(raw) - len(raw.lstrip(_STRIP)) if core else 0
        t.token_start, t.token_end = m.span()
        t.start, t.core = m.start() + lead, core or raw
        t.end = t.start + len(t.core)
        digits = _digits(t.core)
        n = len(digits)
        shape = _shape(t.core)
        t.features = [f"shape {shape[:24]}", f"digits {n if n < 8 else 8 if n < 10 else 10 if n < 12 else 12 if n < 16 else 16 if n < 20 else 20}", f"at {min(2, t.core.count('@'))} {'.' in t.core}", f"dots {min(4, t.core.count('.'))}", f"plus {t.core[:1] == '+'}", f"letters {bool(re.search('[A-Za-z]', t.core))}", "one"]
        if 13 <= n <= 19:
            t.features.append(f"luhn {luhn(digits)}")
        if t.core.count(".") == 3:
            parts = t.core.split(".")
            t.features.append(f"octets {all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts)}")
        t.key = t.core.lower() if n < 7 else f"{shape} {n}"
        out.append(t)
    for a, b in zip(out, out[1:]):
        if b.token_start - a.token_end == 1:
            a.features.append("next " + b.features[0])
            b.features.append("before " + a.features[0])
    return out


def _edges(ts: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between direct neighbours; skip edges from each token to the next one of its key, unless a chain edge joins them."""
    chain = [(i, i + 1) for i in range(len(ts) - 1) if ts[i + 1].token_start - ts[i].token_end == 1]
    chained = set(chain)
    last: dict[str, int] = {}
    skip = []
    for i, t in enumerate(ts):
        if t.key in last and (last[t.key], i) not in chained:
            skip.append((last[t.key], i))
        last[t.key] = i
    return chain, skip


class Field:
    """names: feature to row of `unary`; chain and skip: log potentials of label pairs."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.unary, self.chain, self.skip = names, unary, chain, skip

    def beliefs(self, ts: list[Token], rounds: int = ROUNDS) -> np.ndarray:
        """Marginals by loopy sum-product in the log domain, all messages at once, until they settle.

        Chains alone are trees, where messages are exact; with skip edges messages are damped by half.
        """
        score = np.array([self.unary[[self.names[f] for f in t.features if f in self.names]].sum(axis=0) for t in ts])
        chain, skip = _edges(ts)
        if chain or skip:
            a = np.array([e[0] for e in chain + skip])
            b = np.array([e[1] for e in chain + skip])
            pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
            to_b, to_a = np.zeros((len(a), len(LABELS))), np.zeros((len(a), len(LABELS)))
            keep = 0.5 if skip else 0.0
            for _ in range(max(rounds, len(chain) + 1 if not skip else 0)):
                total = score.copy()
                np.add.at(total, b, to_b)
                np.add.at(total, a, to_a)
                new_b = _log_sum((total[a] - to_a)[:, :, None] + pair, 1)
                new_a = _log_sum((total[b] - to_b)[:, None, :] + pair, 2)
                new_b = keep * to_b + (1 - keep) * (new_b - new_b.max(axis=1, keepdims=True))
                new_a = keep * to_a + (1 - keep) * (new_a - new_a.max(axis=1, keepdims=True))
                moved = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max())
                to_b, to_a = new_b, new_a
                if moved < SETTLED:
                    break
            np.add.at(score, b, to_b)
            np.add.at(score, a, to_a)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Base spans, then those that the field adds where no base span lies; by kind, then start."""
        base = base_spans(text)
        if not text or not self.names or not _DIGIT_OR_AT.search(text):
            return base
        ts = tokens(text)
        if not ts:
            return base
        taken = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.array([])
        p = self.beliefs(ts)
        label = p.argmax(axis=1)
        label[p[np.arange(len(ts)), label] < BELIEF] = 0
        added: list[tuple[str, int, int, int]] = []
        for i, (t, n) in enumerate(zip(ts, label)):
            if not n:
                continue
            k = np.searchsorted(starts, t.token_end) - 1 if len(starts) else -1
            if k >= 0 and reach[k] > t.token_start:
                continue
            if added and added[-1][0] == LABELS[n] and added[-1][3] == i - 1 and t.token_start - ts[i - 1].token_end == 1:
                added[-1] = (LABELS[n], added[-1][1], t.end, i)
            else:
                added.append((LABELS[n], t.start, t.end, i))
        order = {k: i for i, k in enumerate(KINDS)}
        return sorted(base + [a[:3] for a in added], key=lambda s: (order[s[0]], s[1], s[2]))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _teacher(ts: list[Token], base: list[tuple[str, int, int]]) -> list[int]:
    """The label of each token: that of the first base span, in their order, that it overlaps."""
    out = [0] * len(ts)
    ends = [t.token_end for t in ts]
    for kind, s, e in base:
        i = bisect_right(ends, s)
        while i < len(ts) and ts[i].token_start < e:
            out[i] = out[i] or LABELS.index(kind)
            i += 1
    return out


_EXAMPLE = ("features", "label", "left", "right", "skips")


def _examples(docs: DataFrame) -> DataFrame:
    """One row a kind of token, with its count: features, label, labels beside it, and labels across skip edges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts: Counter = Counter()
            for text in f["text"]:
                ts = tokens(text or "")
                labels = _teacher(ts, base_spans(text))
                chain, skip = _edges(ts)
                left, right = dict.fromkeys(range(len(ts)), -1), dict.fromkeys(range(len(ts)), -1)
                across: dict[int, list[int]] = {}
                for a, b in chain:
                    right[a], left[b] = labels[b], labels[a]
                for a, b in skip:
                    across.setdefault(a, []).append(labels[b])
                    across.setdefault(b, []).append(labels[a])
                counts.update(("\n".join(t.features), y, left[i], right[i], "".join(map(str, sorted(across.get(i, []))))) for i, (t, y) in enumerate(zip(ts, labels)))
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=[*_EXAMPLE, "n"])

    each = docs.mapInPandas(run, "features string, label int, left int, right int, skips string, n long")
    return each.groupBy(*_EXAMPLE).agg(F.sum("n").alias("n"))


def _fitted(examples: list, rounds: int = 150) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Unary, chain and skip log potentials by accelerated gradient steps on the convex pseudo-likelihood."""
    seen = Counter()
    for r in examples:
        for f in set(r["features"].split("\n")):
            seen[f] += r["n"]
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    k, many = len(LABELS), np.array([r["n"] for r in examples], dtype=float)
    rows = [[names[f] for f in r["features"].split("\n") if f in names] for r in examples]
    slots = np.full((len(rows), max(map(len, rows), default=0) + 1), len(names))  # the last weight is no feature's and stays 0
    for i, own in enumerate(rows):
        slots[i, : len(own)] = own
    eye = np.eye(k + 1)[:, :k]  # -1, nobody there, is a row of zeros
    left, right = eye[[r["left"] for r in examples]], eye[[r["right"] for r in examples]]
    skips = np.array([np.bincount([int(c) for c in r["skips"]], minlength=k)[:k] for r in examples], dtype=float)
    goal = np.eye(k)[[r["label"] for r in examples]]
    each = np.maximum(1, np.bincount(slots.ravel(), weights=np.repeat(many, slots.shape[1]), minlength=len(names) + 1))[:, None]
    n_chain, n_skip = max(1, (many * (left.sum(1) + right.sum(1))).sum()), max(1, (many * skips.sum(1)).sum())
    w, chain, skip = np.zeros((len(names) + 1, k)), np.zeros((k, k)), np.zeros((k, k))
    speeds = [np.zeros_like(x) for x in (w, chain, skip)]
    for _ in range(rounds):
        u, c, s = (x + 0.9 * v for x, v in zip((w, chain, skip), speeds))
        score = u[slots].sum(axis=1) + left @ c + right @ c.T + skips @ s
        p = np.exp(score - score.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - goal) * many[:, None]
        g_w = np.column_stack([np.bincount(slots.ravel(), weights=np.repeat(off[:, y], slots.shape[1]), minlength=len(names) + 1) for y in range(k)])
        g_c, g_s = left.T @ off + (right.T @ off).T, skips.T @ off
        grads = (g_w / each / 4 + 0.002 * w, g_c / n_chain + 0.002 * chain, (g_s + g_s.T) / 2 / n_skip + 0.002 * skip)
        speeds = [0.9 * v - 0.5 * g for v, g in zip(speeds, grads)]
        w, chain, skip = (x + v for x, v in zip((w, chain, skip), speeds))
        w[-1] = 0
        chain, skip = np.clip(chain, -MOST_AGREEMENT, MOST_AGREEMENT), np.clip(skip, -MOST_AGREEMENT, MOST_AGREEMENT)
    return names, w[:-1], chain, skip


def train(docs: DataFrame, stages: Stages, sample: int = SAMPLE, examples: int = EXAMPLES) -> Field:
    """docs (doc_id, text); the base spans of at most `sample` documents teach the field, by at most `examples` kinds of token."""
    keyed = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    share = 4 * sample / max(1, docs.count())  # rows that are worth sorting: about four times the sample
    low = keyed.select("doc")
    if share < 1:
        low = low.where(F.col("doc") < int(-(2**63) + share * 2**64))
    chosen = stages.put(low.distinct().orderBy("doc").limit(sample), "chosen")
    some = stages.put(keyed.join(F.broadcast(chosen), "doc").dropDuplicates(["doc"]), "sample")
    rows = _examples(some).orderBy(F.xxhash64(*_EXAMPLE), *_EXAMPLE).limit(examples).collect()
    k = len(LABELS)
    if not any(r["label"] for r in rows):
        return Field({}, np.zeros((0, k)), np.zeros((k, k)), np.zeros((k, k)))
    return Field(*_fitted(rows))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def found(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text) to the counts and digests of the spans in each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.unary, field.chain, field.skip))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(own.spans(text))))
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, type=t) for c, t in zip(columns, kinds)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; n_chars follows if it is there."""
    shared = docs.sparkSession.sparkContext.broadcast((field.names, field.unary, field.chain, field.skip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            clean = pa.array([None if t is None else redact(t, own.spans(t)) for t in texts], type=pa.string())
            arrays = [clean if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "personal")
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return found(docs, train(docs, stages))


QUERIES = {"op4_personal_data": op4_personal_data}
ORACLE_SQL: dict[str, str] = {}
