"""An extension: new records are matched against those already there, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from amalgam.operators.match import apply_rules
from amalgam.plans.rules import RuleSet


def match_stream(stream: DataFrame, rules: RuleSet, records_path: str, pairs_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch joins the stored records and itself; pairs of two stored records are not made again.

    Batches write under their own number and overwrite it, so a batch that runs again changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.persist()
        fresh.write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        every = spark.read.parquet(records_path).where(f"batch <= {number}").drop("batch")
        apply_rules(every, rules, fresh=fresh.select("row_id").distinct()).write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")
        fresh.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()
