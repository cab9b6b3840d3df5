"""Running totals and numbers over a whole table's order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.storage import materialize


def running_total(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum (long) of value over all rows that come before by order, whose values must be distinct.

    Rows are dealt by ranges of order and written; each range's total (a row for each partition) goes to the driver,
    and what lies before a range is added to the total within it.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(order).withColumn("quern_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    totals = dealt.groupBy("quern_range").agg(F.sum(value).alias("n")).orderBy("quern_range").collect()
    offsets, so_far = [], 0
    for r in totals:
        offsets.append((r.quern_range, so_far))
        so_far += r.n or 0
    before = F.broadcast(spark.createDataFrame(offsets, "quern_range int, quern_offset long"))
    within = F.sum(value).over(Window.partitionBy("quern_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return dealt.join(before, "quern_range").withColumn(name, (F.col("quern_offset") + within).cast("long")).drop("quern_range", "quern_offset")


def numbered(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """df with each row's number from 0 by order, whose values must be distinct."""
    return running_total(df.withColumn("quern_one", F.lit(1)), order, "quern_one", name).drop("quern_one")
