"""A session with the settings that the engine expects; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, **settings: str) -> SparkSession:
    cores = cores or os.cpu_count() or 4
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=defaults | settings).getOrCreate()
