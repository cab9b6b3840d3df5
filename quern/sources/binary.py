"""Records of fixed width as raw bytes: keys and values next to each other without a header."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.stores import files, opened

_KINDS = {"long": "<i8", "bigint": "<i8", "int": "<i4", "double": "<f8", "float": "<f4"}


def layout(schema: str) -> np.dtype:
    """'k long, v double' as a packed little-endian record."""
    return np.dtype([(n, _KINDS[t]) for n, t in (f.split() for f in schema.split(","))])


def packed(df: DataFrame) -> DataFrame:
    """One binary value for each record of df, whose columns are of fixed width and not null."""
    kind = layout(", ".join(f"{n} {t}" for n, t in df.dtypes))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.empty(len(pdf), dtype=kind)
            for c in kind.names:
                rows[c] = pdf[c].to_numpy()
            raw = rows.tobytes()
            yield pd.DataFrame({"value": [raw[i : i + kind.itemsize] for i in range(0, len(raw), kind.itemsize)]})

    return df.mapInPandas(each, "value binary")


def write_binary(df: DataFrame, path: str) -> int:
    """df's records, whose columns are of fixed width and not null, next to each other in files part-00000 on of a new
    folder; returns how many. Only counts come to the driver.

    A task writes under a name of its own attempt and renames the file when it is whole, so that a task run again leaves
    one file. The folder must be in a store that pyarrow knows, shared by all executors.
    """
    kind = layout(", ".join(f"{n} {t}" for n, t in df.dtypes))
    store, own = opened(path)
    from pyarrow import fs

    if store.get_file_info(own).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    store.create_dir(own)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        store, own = opened(path)
        tried = f"{own}/.try-{task.partitionId():05d}-{task.taskAttemptId()}"
        with store.open_output_stream(tried) as out:
            for batch in batches:
                rows = np.empty(batch.num_rows, dtype=kind)
                for c in kind.names:
                    rows[c] = batch.column(c).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                n += len(rows)
        store.move(tried, f"{own}/part-{task.partitionId():05d}")
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(each, "n long").agg(F.sum("n")).first()[0] or 0


def read_binary(spark: SparkSession, path: str, schema: str, split_bytes: int = 64_000_000) -> DataFrame:
    """The records of raw files of one schema, which must hold whole records; files are read in splits of whole records.

    Files must be in a store that pyarrow knows, and may have any size.
    """
    kind = layout(schema)
    step, splits = max(1, split_bytes // kind.itemsize) * kind.itemsize, []
    for name, size in files(spark, [path]):
        if size % kind.itemsize:
            raise ValueError(f"{size} bytes of {name} are not whole records of {kind.itemsize}")
        splits += [(name, a, min(step, size - a)) for a in range(0, size, step)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, own = opened(name)
                with store.open_input_file(own) as f:
                    f.seek(at)
                    for a in range(0, size, 100_000 * kind.itemsize):
                        rows = np.frombuffer(f.read(min(size - a, 100_000 * kind.itemsize)), dtype=kind)
                        yield pa.record_batch({c: pa.array(np.ascontiguousarray(rows[c])) for c in kind.names})

    return spark.createDataFrame(splits, "name string, at long, size long").repartition(max(1, len(splits))).mapInArrow(each, schema)


def unpacked(df: DataFrame, schema: str) -> DataFrame:
    """The records of a column `value` of packed ones."""
    return df.select(F.col("value").alias("content")).mapInPandas(_reader(layout(schema)), schema)


def _reader(kind: np.dtype):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.frombuffer(b"".join(pdf["content"]), dtype=kind)
            yield pd.DataFrame({c: rows[c] for c in kind.names})

    return each
