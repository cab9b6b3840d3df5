"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task reads within small_tasks.
SPLIT = 16 << 20
#: Spark's setting by which the shuffle files of a query go as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By folder, each written table that may still be read: its context, and a weak reference to the JVM's list of its files.
_WRITTEN: dict[str, tuple[object, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's. Where neither is set, a session in one process (tests) gets a
    new temporary one; any other is an error, as its executors wouldn't see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def _settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def parts_for(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """How many partitions to deal rows out to: each rows of them in one, or the session's number of partitions if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Within it, what a task of a query reads has a bound that doesn't grow with the input: one of rows' partitions, merged
    up to SPLIT bytes at most, or SPLIT bytes of files. Queries must end within it."""
    with _settings(spark, **{
        "spark.sql.shuffle.partitions": str(parts_for(spark, rows)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(SPLIT),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * SPLIT),
        "spark.sql.files.maxPartitionBytes": str(SPLIT),
    }):
        yield


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Deletes the written tables that no plan reads any more, as far as the JVM has collected their plans."""
    for path, (context, files) in list(_WRITTEN.items()):
        if context is not spark.sparkContext:  # an ended session's, which went with it
            _WRITTEN.pop(path, None)
        elif files.refersTo(None) and _WRITTEN.pop(path, None):
            _delete(spark, path)


def collect(spark: SparkSession) -> None:
    """sweep, with the plans that nothing holds collected first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    sweep(spark)


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize gave and that nothing reads any more, without waiting for the JVM."""
    for df in tables:
        _WRITTEN.pop(df.written_at, None)
        _delete(df.sparkSession, df.written_at)


def materialize(df: DataFrame, label: str, block: int | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again.

    It cuts lineage (a lost executor costs a re-read, not a recomputation), gives Catalyst real sizes to choose joins
    by, and lets several consumers share one pass over the input. The shuffle files of the write go as it ends. The table
    goes by release, or before a later table is written once no DataFrame, plan or cache reads it (an RDD made of one does
    not count), or when the session's JVM ends. block: the bytes of its row groups, which tasks don't read in parts.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _settings(spark, **{_CLEANUP: "true"}):
        df.write.options(**{"parquet.block.size": block} if block else {}).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    plan = out._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":  # all plans over it share this list of files
        _WRITTEN[path] = (spark.sparkContext, spark.sparkContext._jvm.java.lang.ref.WeakReference(plan.relation().location()))
    return out
