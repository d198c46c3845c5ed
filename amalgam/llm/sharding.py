"""Sharding by a K-d tree over metadata, cut at exact weighted medians.

A node that shall hold k shards is cut along its widest dimension (its extent against the table's) where
floor(k / 2) / k of its bytes lie below, until every node is one shard: k comes from the target bytes.
Each level range-sorts the narrow rows of open nodes once, sums bytes by range, and looks for the cut
within the single range that holds it. The place of a text in its dimension is its rank among the distinct
texts, whole. Order within a dimension is by value, then by row, so a value
that a third of all rows share is cut like any other. Only one row a node reaches the driver.

Cases: a null text has no bytes (16 of overhead stay), null metadata comes first in its dimension,
repeated rows are told apart by row; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import Stages, numbered, read

SHARDS = 40
OVERHEAD = 16
DIMENSIONS = ("doc", "length", "lang", "source")


def _places(values: DataFrame, stages: Stages, column: str) -> DataFrame:
    """The distinct values of a text column with `place`: their exact rank, "" (and null) first.

    Values are range sorted; each range numbers its own, and starts where the ranges before it end.
    """
    spark = values.sparkSession
    distinct = values.select(F.coalesce(column, F.lit("")).alias(column)).distinct()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stages.put(distinct.repartitionByRange(width, column).withColumn("part", F.spark_partition_id()), f"values-{column}")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return stages.put(ranged.withColumn("i", inside).join(F.broadcast(starts), "part").select(column, (F.col("before") + F.col("i")).cast("double").alias("place")), f"places-{column}")


def described(docs: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, size, text_crc32 and a double for each dimension; of texts, the rank of the whole value."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    out = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)).alias("doc"), F.log2(size.cast("double")).alias("length"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )
    out = stages.put(out, "described")
    for column in ("lang", "source"):
        out = out.join(_places(out, stages, column), column).drop(column).withColumnRenamed("place", column)
    return out


def _cuts(ranged: DataFrame, targets: dict[int, float], spark: SparkSession) -> dict[int, tuple[float, int]]:
    """Of each node the last (place, uid) that stays left."""
    goals = F.broadcast(spark.createDataFrame([(n, float(t)) for n, t in targets.items()], "node int, target double"))
    sums = ranged.groupBy("node", "part").agg(F.sum("size").alias("s"), F.min(F.struct("place", "uid")).alias("first"))
    before = F.sum("s").over(Window.partitionBy("node").orderBy("part")) - F.col("s")
    run = sums.withColumn("before", before).join(goals, "node")
    # the range in which the running sum passes the target: the last that starts at or below it
    holder = run.where("before <= target").groupBy("node").agg(F.max_by(F.struct("part", "before", "target", "first"), "part").alias("h"))
    held = {r["node"]: r["h"] for r in holder.collect()}
    small = spark.createDataFrame([(n, h["part"], float(h["before"]), float(h["target"])) for n, h in held.items()], "node int, part int, before double, target double")
    inside = ranged.join(F.broadcast(small), ["node", "part"])
    reach = F.col("before") + F.sum("size").over(Window.partitionBy("node").orderBy("place", "uid"))
    found = inside.withColumn("off", F.abs(reach - F.col("target"))).groupBy("node").agg(F.min_by(F.struct("place", "uid"), F.struct("off", "place", "uid")).alias("at"), F.min("off").alias("off"))
    out = {}
    for r in found.collect():
        h = held[r["node"]]
        if h["before"] > 0 and h["target"] - h["before"] < r["off"]:
            out[r["node"]] = (h["first"]["place"], h["first"]["uid"] - 1)
        else:
            out[r["node"]] = (r["at"]["place"], r["at"]["uid"])
    return out


def kd_shards(rows: DataFrame, stages: Stages, dimensions: tuple[str, ...] = DIMENSIONS, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """rows (size and a double for each dimension) with `shard` and `uid`, from 0 in order of the tree's leaves."""
    spark = rows.sparkSession
    now = stages.put(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    root = now.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), *[F.coalesce(F.max(d) - F.min(d), F.lit(0.0)).alias(d) for d in dimensions]).first()
    if shards is None:
        shards = max(1, round(root["w"] / target_bytes))
    first = {0: 0}  # of a node the first shard below it
    leaves = {0: shards}
    current = now.withColumn("node", F.lit(0))
    closed: list[DataFrame] = []
    level = 0
    while any(k > 1 for k in leaves.values()):
        widths = current.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).collect()  # one row a node
        chosen = {r["node"]: max(range(len(dimensions)), key=lambda i: (r[dimensions[i]] / root[dimensions[i]] if root[dimensions[i]] else 0, -i)) for r in widths if leaves[r["node"]] > 1}
        if not chosen:
            break
        weights = {r["node"]: r["w"] for r in widths}
        at = spark.createDataFrame(list(chosen.items()), "node int, dimension int")
        place = F.element_at(F.array(*dimensions), F.col("dimension") + 1)
        opened = current.join(F.broadcast(at), "node").withColumn("place", place).drop("dimension")
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = stages.put(opened.repartitionByRange(width, "node", "place", "uid").withColumn("part", F.spark_partition_id()), f"level{level}")
        cuts = _cuts(ranged, {n: weights[n] * (leaves[n] // 2) / leaves[n] for n in chosen}, spark)
        closed.append(current.where(F.col("node").isin([n for n, k in leaves.items() if k == 1])))
        table, nxt, nxt_first = [], {}, {}
        for n, (p, u) in cuts.items():
            left, right, half = 2 * n + 1, 2 * n + 2, leaves[n] // 2
            nxt |= {left: half, right: leaves[n] - half}
            nxt_first |= {left: first[n], right: first[n] + half}
            table.append((n, float(p), int(u), left, right))
        first |= nxt_first
        leaves |= nxt
        side = spark.createDataFrame(table, "node int, cut_place double, cut_uid long, low int, high int")
        below = (F.col("place") < F.col("cut_place")) | ((F.col("place") == F.col("cut_place")) & (F.col("uid") <= F.col("cut_uid")))
        current = ranged.join(F.broadcast(side), "node").withColumn("node", F.when(below, F.col("low")).otherwise(F.col("high"))).drop("place", "part", "cut_place", "cut_uid", "low", "high")
        for n in cuts:
            del leaves[n]
        level += 1
    out = current
    for c in closed:
        out = out.unionByName(c)
    names = spark.createDataFrame([(n, first[n]) for n in leaves], "node int, shard int")
    return out.join(F.broadcast(names), "node").drop("node")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "sharding")
    dealt = stages.put(kd_shards(described(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), stages), stages, shards=SHARDS).select("doc_id", "size", "text_crc32", "shard", "uid"), "dealt")
    return numbered(dealt, stages, ["shard"], "uid", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL: dict[str, str] = {}
