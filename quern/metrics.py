"""Counts of a job's records, taken as it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and what will hold {"records": n} once an action has run over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records")), seen
