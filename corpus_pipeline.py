"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm import jaccard_join, mixing, packing, personal_data, toxicity
from amalgam.llm.common import Stages, fresh, key_filter, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores under one half.

    Null and blank texts match nothing and stay; repeated rows score alike and stay or go together; an empty
    table stays empty; without labels the fixed seeds and prior weights decide.
    """
    grammar = toxicity.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"), Stages(spark, "pipeline-toxicity"))
    score = fresh(docs, "toxic_score")
    return toxicity.scored(docs, grammar, docs.columns, score).where(F.col(score) < 0.5).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the least doc_id; of its repeated rows, one.

    Null, empty and blank texts have no links, so all of them stay, repeated or not; a null doc_id counts as the
    largest. Only rows that a filter by key takes for linked are shuffled; all others pass straight through.
    """
    classes = jaccard_join.jaccard_classes(docs.select("doc_id", "text"), Stages(spark, "pipeline-jaccard"))
    key, stays, one = (fresh(docs, c) for c in ("row_key", "row_stays", "row_once"))
    linked = classes.where("n_links > 0").select(F.col("row").alias(key), (F.col("row") == F.col("stays")).alias(stays)).distinct()
    linked = Stages(spark, "pipeline-linked").put(linked, "linked")
    keyed = docs.withColumn(key, jaccard_join.row_key())
    may_be_linked = key_filter(linked.select(key))
    alone = keyed.where(~may_be_linked(key))
    some = keyed.where(may_be_linked(key)).join(linked, key, "left").where(F.coalesce(stays, F.lit(True)))
    # repeated rows of the document that stays share their key and a null; rows without links are each on their own
    some = some.withColumn(one, F.when(F.col(stays).isNull(), F.monotonically_increasing_id())).dropDuplicates([key, one])
    return alone.select(*docs.columns).unionByName(some.select(*docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in angle brackets.

    Null and blank texts stay as they are, repeated rows are replaced alike, and an empty table stays empty.
    """
    field = personal_data.train(docs.select("doc_id", "text"), Stages(spark, "pipeline-personal"))
    return personal_data.redacted(docs, field)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated probabilities sample (DataFrame functions only).

    Null and blank texts have no tokens and stay; rows with one doc_id share a draw; a table without any
    tokens stays whole.
    """
    stages = Stages(spark, "pipeline-mixing")
    cells = mixing.probabilities(stages.put(mixing.described(docs), "described"), stages)
    names = {c: fresh(docs, f"mix_{c}") for c in (*mixing.DIMENSIONS, "p")}
    source, lang, topic, p = names.values()
    keyed = docs.withColumns({source: F.coalesce("source", F.lit("")), lang: F.coalesce("lang", F.lit("")), topic: mixing.topic_of(F.col("text"))})
    rated = keyed.join(cells.drop("f").withColumnsRenamed(names), [source, lang, topic], "left")
    chance = F.when(mixing.has_tokens(F.col("text")), F.coalesce(F.col(p), F.lit(1.0))).otherwise(F.lit(1.0))
    drawn = mixing.draw("mix", F.col("doc_id"), mixing.n_tokens(F.col("text")), *[F.col(c) for c in (source, lang, topic)])
    return rated.where(drawn < chance).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: where each piece of each document lies.

    A null or empty text is one piece of the end token alone; repeated rows are packed each on their own; an empty
    table gives no pieces.
    """
    return packing.pack(packing.pieces(docs.select("doc_id", "text")), Stages(spark, "pipeline-packing"))


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written to the shared folder and read again."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stages.put(docs, name.replace(" ", "-"))
    return docs
