"""Tables staged in the shared folder, and connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (one local process only) one of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="amalgam-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


class Stages:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/amalgam/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.amalgam_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.amalgam_path)
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, stages: Stages, limit: int = 60) -> DataFrame:
    """(v, c) for every vertex of `edges` (a, b longs): c is the least vertex of its component.

    Each round a vertex takes the least label among its neighbours, its label's own vertex takes the least
    that any vertex with that label has seen, and labels are replaced by their labels' labels; rounds, in
    number about the logarithm of a component, stop when nothing changes. Minima combine before each shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stages.put(both.where("a <> b").distinct(), "edges")
    labels = stages.put(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("v"), "c"), "labels")
    for _ in range(limit):
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m")).withColumnRenamed("a", "v")
        seen = stages.put(labels.join(near, "v"), "seen")
        hook = seen.groupBy(F.col("c").alias("v")).agg(F.min("m").alias("h"))
        least = stages.put(seen.join(hook, "v", "left").select("v", F.col("c").alias("old"), F.least("c", "m", F.coalesce("h", "c")).alias("c")), "least")
        up = least.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        done = stages.put(least.join(up, "c").select("v", "old", F.least("c", "cc").alias("c")), "labels")
        moved = done.where("c <> old").limit(1).count()
        stages.drop(labels, seen, least)
        path = done.amalgam_path
        labels = done.select("v", "c")
        labels.amalgam_path = path
        if not moved:
            stages.drop(both)
            return labels
    raise RuntimeError(f"components did not settle within {limit} rounds")


def staged(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: it cuts lineage, and unlike checkpoint()
    the estimates of the plan's size too, which otherwise multiply with each round's joins."""
    return Stages(df.sparkSession, "staged").put(df, "table")


#: How many edges a task of forest() holds at once.
HELD = 1_000_000


def forest(edges: DataFrame, held: int = HELD) -> DataFrame:
    """Edges (idx_a, idx_b) with the components of those given: of each run of `held` edges in a partition a spanning forest.

    For many more edges than vertices: fewer are left to be shuffled.
    """

    def work(frames):
        kept = []
        for f in chain(frames, [None]):
            if f is not None:
                kept.append(f)
            if kept and (f is None or sum(map(len, kept)) >= held):
                ids, at = np.unique(np.concatenate([k[c].to_numpy(np.int64) for c in ("idx_a", "idx_b") for k in kept]), return_inverse=True)
                a, b = at.reshape(2, -1)
                label = np.arange(len(ids))
                while (apart := label[a] != label[b]).any():  # labels are roots: the larger of two hangs on the smaller
                    a, b = a[apart], b[apart]
                    np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
                    while (label != (up := label[label])).any():
                        label = up
                on = label != np.arange(len(ids))
                yield pd.DataFrame({"idx_a": ids[label[on]], "idx_b": ids[on]})
                kept = []

    return edges.select(F.col("idx_a").cast("long").alias("idx_a"), F.col("idx_b").cast("long").alias("idx_b")).mapInPandas(work, "idx_a long, idx_b long")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, limit: int = 60) -> DataFrame:
    """edges (idx_a, idx_b) to (row_id, cluster_id): the least row of the component.

    Vertices without an edge are clusters of their own, if `vertices` (row_id) are given.
    """
    found = components(edges.select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b")), Stages(edges.sparkSession, "components"), limit)
    out = found.select(F.col("v").alias("row_id"), F.col("c").alias("cluster_id"))
    if vertices is None:
        return out
    return vertices.select("row_id").join(out, "row_id", "left").select("row_id", F.coalesce("cluster_id", "row_id").alias("cluster_id"))


def largest_component(edges: DataFrame) -> DataFrame:
    """One row: the size of the largest component, 0 if none has two members."""
    sizes = connected_components(edges).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("largest_cluster"))
