"""Word counts of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans.workloads import word_count


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """word, cnt over all lines that have come into the folder; write it with outputMode complete or update."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return word_count(lines, "value")
