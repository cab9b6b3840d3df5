"""Sessions with the settings that the library is meant to run under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: What the engine's tuning knobs come to in Spark: adaptive execution deals out and splits skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session; master and conf only fill in what the cluster hasn't set (conf: underscores for dots)."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master or "MASTER" in os.environ:
        builder = builder.master(master or os.environ["MASTER"])
    return builder.config(map={k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
