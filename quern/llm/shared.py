"""What the operators of this package share: tables, words and learning folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import collect, materialize, release  # noqa: F401  the operators take them from here

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int = 0, rows: int = 500, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in views of at most `rows` rows and about `size` bytes of the column `text`, none copied.

    What Python makes of a slice is so bounded by the slice or one text, whatever the session's batches hold.
    """
    import pyarrow.compute as pc

    for batch in batches:
        long = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(long, (long[a - 1] if a else 0) + size, "right"))
            b = max(a + 1, min(a + rows, b))
            yield batch.slice(a, b - a)
            a = b


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """each, over Arrow batches or pandas frames, with what it has freed given back to the system at its end.

    Workers are used again, and would keep it beside the JVM while other stages run. An empty last batch makes the reader
    let go of the one before.
    """

    def run(batches: Iterator) -> Iterator:
        out = None
        for out in each(batches):
            yield out
        if out is not None:
            out = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in out.schema], schema=out.schema) if isinstance(out, pa.RecordBatch) else out.iloc[:0].copy()
            yield out
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc alone has it
            libc.malloc_trim(0)

    return run


def remainder_is(doc_id: str, mod: int, rest: int) -> Column:
    """True where crc32(doc_id as text) mod `mod` is `rest`, and for a null doc_id: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most about `bound` learnable rows of each label, whatever the corpus's size.

    Labels are thinned by a hash of doc_id to the bound first, so that what is broadcast to meet the texts has a proven
    size (2 * bound ids) and no text is shuffled. Null ids, null labels and ids with contrary labels take no part.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").drop("y2").where(learn)
    )
    n = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, min(1.0, bound / max(1, n.get(1, 0)))).otherwise(min(1.0, bound / max(1, n.get(0, 0))))
    ids = ids.where(unit < rate)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null")
