"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents are counted into cells of source x language x topic; each round rakes the cells' token
weights to the source, the language and the topic marginals in turn. A document of cell c then stays
with probability min(1, s * f_c), where f_c is the cell's raked over its present share and s is
calibrated so that the expected tokens meet the budget; where the cap of 1 binds, s makes up for it.

Cases: null source, language or topic is a category of its own (""); a null or blank text has no
tokens and always stays, with factor and probability 1; rows with one doc_id share one draw, and rows
without an id draw by their number of tokens and cell; a table with no tokens at all keeps every document.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, read

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 10
CALIBRATIONS = 12
#: Rounds go on, five at a time, until no marginal is further than this from its target. Targets that no weights can
#: meet end them, with a warning, once five rounds bring next to nothing, or at MOST_ROUNDS.
TOLERANCE = 1e-6
MOST_ROUNDS = 200
MOST_CALIBRATIONS = 200

#: Topics by the first pattern that a text holds, in this order; others are "prose".
TOPICS = (
    ("licence", "(MIT License|Apache License|All rights reserved|CC BY|GNU General Public)"),
    ("table", r" \| [^|]+ \| "),
    ("symbols", r"[%$&#*]{3}"),
    ("shouting", "[A-Z]{2,}!!"),
    ("contact", "@[a-z0-9]+[.]"),
)


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def has_tokens(text: Column) -> Column:
    return F.coalesce(text.rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))


def _targets(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Target share of each value: its token share to the power `exponent`, scaled to 1."""
    own = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("m")).where("m > 0")
    own = own.withColumn("p", F.pow("m", F.lit(exponent)))
    return own.crossJoin(F.broadcast(own.agg(F.sum("p").alias("all")))).select(dimension, (F.col("p") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], stages: Stages, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (dimensions, tokens) with `w`: shares whose marginals meet `targets` (value, target).

    Targets join the cells once; each rake is then one window sum over counted cells, so five rounds are
    one plan that is as long as there are rakes. Only the largest miss reaches the driver.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("all"))
    now = cells.crossJoin(F.broadcast(total)).withColumn("w", F.col("tokens") / F.col("all")).drop("all").where("tokens > 0")
    for d in targets:
        now = now.join(targets[d].withColumnRenamed("target", f"target_{d}"), d)
    now, done, miss, last = stages.put(now, "cells"), 0, 1.0, 2.0
    while done < rounds or (tolerance < miss < 0.98 * last and done < MOST_ROUNDS):
        for _ in range(min(5, rounds - done) if done < rounds else 5):
            for d in targets:
                sums = F.sum("w").over(Window.partitionBy(d))
                now = now.withColumn("s", sums).withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col(f"target_{d}") / F.col("s")).otherwise(F.lit(0.0))).drop("s")
            done += 1
        now = stages.put(now, "cells")
        if done >= rounds:
            last = miss if done > rounds else 2.0
            misses = [now.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"target_{d}")).alias("miss")).agg(F.coalesce(F.max("miss"), F.lit(0.0)).alias("miss")) for d in targets]
            miss = reduce(DataFrame.unionByName, misses).agg(F.max("miss")).first()[0] or 0.0
    if miss > tolerance:
        warnings.warn(f"after {done} rounds a marginal misses its target by {miss:.2g}", stacklevel=2)
    return now.drop(*[f"target_{d}" for d in targets])


def calibrate(cells: DataFrame, fraction: float, stages: Stages) -> DataFrame:
    """Raked cells with factor f and probability p = min(1, s * f); the expected tokens are the budget.

    Each step sums the cells that are full and those that are not; only these numbers reach the driver, and
    steps end when the budget is met or every cell is full.
    """
    shares = cells.crossJoin(F.broadcast(cells.agg(F.sum("tokens").cast("double").alias("all")))).withColumn("f", F.col("w") * F.col("all") / F.col("tokens"))
    shares = stages.put(shares, "shares")
    scale = fraction
    for _ in range(MOST_CALIBRATIONS):
        p = F.least(F.lit(1.0), F.lit(scale) * F.col("f"))
        full, free, total = shares.agg(F.coalesce(F.sum(F.when(p >= 1, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(p < 1, p * F.col("tokens"))), F.lit(0.0)), F.coalesce(F.max("all"), F.lit(0.0))).first()
        if free <= 0 or (fraction * total - full) / free <= 1 + 1e-12:
            break
        scale *= (fraction * total - full) / free
    return shares.withColumn("p", F.least(F.lit(1.0), F.lit(scale) * F.col("f")))


def unit_interval(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5; the same in any SQL engine."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw(seed: str, doc_id: Column, *others: Column) -> Column:
    """The number in [0, 1) that decides on a row: by its id, and for a row without one by `others`."""
    return F.when(doc_id.isNotNull(), unit_interval(seed, doc_id)).otherwise(unit_interval(seed, F.lit(""), *others))


def probabilities(docs: DataFrame, stages: Stages, fraction: float = 0.6, exponent: float = 0.5, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """docs (dimensions, n_tokens) to one row a cell that has tokens: its factor f and probability p."""
    cells = stages.put(keyed(docs).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "counts")
    fixed = targets or {d: stages.put(_targets(cells, d, exponent), f"target-{d}") for d in DIMENSIONS}
    return stages.put(calibrate(rake(cells, fixed, stages, rounds), fraction, stages).select(*DIMENSIONS, "f", "p"), "probabilities")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({d: F.coalesce(d, F.lit("")) for d in DIMENSIONS})


def mix(docs: DataFrame, cells: DataFrame, seed: str = "mix") -> DataFrame:
    """docs (doc_id, dimensions, ...) with weight (the cell's factor), probability and sampled.

    There are as many cells as values occur together; Spark broadcasts them while they are small.
    """
    some = F.col("n_tokens") > 0
    out = keyed(docs).join(cells, list(DIMENSIONS), "left").withColumns({c: F.when(some, F.coalesce(c, F.lit(1.0))).otherwise(F.lit(1.0)) for c in ("f", "p")})
    return out.withColumns({"weight": F.round("f", 6), "probability": F.round("p", 6), "sampled": draw(seed, F.col("doc_id"), F.col("n_tokens"), *[F.col(d) for d in DIMENSIONS]) < F.col("p")}).drop("f", "p")


def described(docs: DataFrame) -> DataFrame:
    """The columns that mix() needs, from documents."""
    return docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "mixing")
    docs = stages.put(described(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")), "described")
    return mix(docs, probabilities(docs, stages)).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")


def _sql() -> str:
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    dims = ", ".join(DIMENSIONS)
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n_tokens FROM documents)",
        f"c AS MATERIALIZED (SELECT {dims}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
        f"r0 AS MATERIALIZED (SELECT {dims}, tokens, tokens / (SELECT sum(tokens)::DOUBLE FROM c) AS w FROM c WHERE tokens > 0)",
    ]
    for d in DIMENSIONS:
        parts.append(f"m_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens)::DOUBLE, 0.5) AS p FROM c GROUP BY {d} HAVING sum(tokens) > 0)")
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, p / (SELECT sum(p) FROM m_{d}) AS target FROM m_{d})")
    last = "r0"
    for i in range(ROUNDS):
        for d in DIMENSIONS:
            now = f"r{i + 1}_{d}"
            parts.append(f"{now} AS MATERIALIZED (SELECT {dims}, tokens, w * (SELECT target FROM t_{d} t WHERE t.{d} = r.{d}) / sum(w) OVER (PARTITION BY {d}) AS w FROM {last} r)")
            last = now
    parts.append(f"k0 AS MATERIALIZED (SELECT *, least(1.0::DOUBLE, 0.6::DOUBLE * f) AS p FROM (SELECT *, (SELECT sum(tokens)::DOUBLE FROM {last}) AS total, w * (SELECT sum(tokens)::DOUBLE FROM {last}) / tokens AS f FROM {last}))")
    for i in range(CALIBRATIONS):
        full = f"(SELECT coalesce(sum(tokens) FILTER (p >= 1), 0) FROM k{i})"
        free = f"(SELECT coalesce(sum(p * tokens) FILTER (p < 1), 0.0) FROM k{i})"
        parts.append(f"k{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN p >= 1 THEN 1.0::DOUBLE WHEN {free} <= 0 THEN p ELSE least(1.0::DOUBLE, p * greatest(1.0::DOUBLE, (0.6::DOUBLE * total - {full}) / {free})) END AS p) FROM k{i})")
    key = f"CASE WHEN d.doc_id IS NOT NULL THEN concat_ws('|', 'mix', d.doc_id::VARCHAR) ELSE concat_ws('|', 'mix', '', d.n_tokens::VARCHAR, {', '.join('d.' + x for x in DIMENSIONS)}) END"
    u = f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    same = " AND ".join(f"d.{x} = k.{x}" for x in DIMENSIONS)
    one = lambda x: f"CASE WHEN d.n_tokens > 0 THEN coalesce(k.{x}, 1.0::DOUBLE) ELSE 1.0::DOUBLE END"
    return f"WITH {', '.join(parts)} SELECT d.doc_id, {', '.join('d.' + x for x in DIMENSIONS)}, d.n_tokens, round({one('f')}, 6) AS weight, round({one('p')}, 6) AS probability, {u} < {one('p')} AS sampled FROM d LEFT JOIN k{CALIBRATIONS} k ON {same}"


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {"op7_mixing": _sql()}
