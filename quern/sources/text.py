"""Text files: lines, pairs and the text form of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import general, parse_integer, tokens
from quern.sources.stores import files, opened


def list_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Every file of the paths, folders searched through; only names that begin with a dot are left out."""
    return [path for path, _ in files(spark, paths)]


def _hidden(path: str) -> bool:
    """Whether Spark's readers pass over a file, which they do in silence."""
    name = path.rsplit("/", 1)[-1]
    return name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def read_lines(spark: SparkSession, paths: str | Sequence[str], separator: str = "\n", split_bytes: int | None = None) -> DataFrame:
    r"""value: a record for each line of every file that list_files finds. Only the separator ends one; blank lines count,
    \r and tabs stay. A NUL ends a record early; what follows it is another record.

    Files are split, by split_bytes if given (else by spark.sql.files.maxPartitionBytes). Those whose names Spark's
    readers pass over are read by read_records, one task each.
    """
    found = list_files(spark, [paths] if isinstance(paths, str) else paths)
    plain, hidden = [p for p in found if not _hidden(p)], [p for p in found if _hidden(p)]
    parts = []
    if plain or not hidden:
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        if split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        try:
            parts.append(spark.read.option("lineSep", separator).schema("value string").text(plain) if plain else spark.createDataFrame([], "value string"))
            if split_bytes:
                parts[0].rdd.getNumPartitions()  # the plan is made, and so split, here
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    if hidden:
        parts.append(read_records(spark, hidden, at_separator(separator)))
    return reduce(DataFrame.unionAll, parts).select(F.explode(F.split("value", "\0")).alias("value"))


def at_separator(separator: str) -> Callable[[bytes, bool], tuple[list[bytes], bytes]]:
    """A boundary for read_records: records end with the separator; a last one needs none."""
    mark = separator.encode()

    def split(chunk: bytes, last: bool) -> tuple[list[bytes], bytes]:
        *records, rest = chunk.split(mark)
        return (records + [rest] if last and rest else records), b"" if last else rest

    return split


def read_records(spark: SparkSession, paths: str | Sequence[str], boundary: Callable[[bytes, bool], tuple[list[bytes], bytes]], chunk: int = 1 << 20) -> DataFrame:
    """value: the records that boundary(bytes, whether they end the file) finds, which returns them and the rest that it leaves.

    For record forms that no separator can tell. A file is read in one task, chunk by chunk; the rest is put before the
    next chunk. Files must be in a store that pyarrow knows (local, HDFS, S3, GCS, Azure); another is an error.
    """
    found = list_files(spark, [paths] if isinstance(paths, str) else paths)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, own = opened(path)
                with store.open_input_stream(own) as stream:
                    rest, more = b"", True
                    while more:
                        new = stream.read(chunk)
                        more = bool(new)
                        records, rest = boundary(rest + new, not more)
                        for a in range(0, len(records), 10_000):
                            yield pa.record_batch({"value": pa.array([r.decode("utf-8", "replace") for r in records[a : a + 10_000]], pa.string())})

    each_file = spark.createDataFrame([(p,) for p in found], "path string")
    return each_file.repartition(max(1, len(found))).mapInArrow(each, "value string")


def read_pairs(spark: SparkSession, paths: str | Sequence[str], numbers: bool = False, checked: bool = True) -> DataFrame:
    """key, value: the first two space-separated fields of each line; with numbers, integers by the base rule.

    A line of fewer fields is an error when checked, else it is left out.
    """
    df = read_lines(spark, paths).select(F.filter(F.split("value", " "), lambda w: w != "").alias("f"), "value")
    enough = F.size("f") >= 2
    if checked:
        df = df.where(F.when(enough, True).otherwise(F.raise_error(F.concat(F.lit("fewer than two fields: "), "value")).cast("boolean")))
    else:
        df = df.where(enough)
    read = parse_integer if numbers else (lambda c: c)
    return df.select(read(F.col("f")[0]).alias("key"), read(F.col("f")[1]).alias("value"))


def read_points(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """x, y, z of lines of three space-separated numbers."""
    f = tokens(F.col("value"))
    return read_lines(spark, paths).select(f.alias("f")).where("size(f) >= 3").selectExpr("try_cast(f[0] AS double) x", "try_cast(f[1] AS double) y", "try_cast(f[2] AS double) z")


def formatted(df: DataFrame) -> Column:
    """A record's text: its columns in order with a blank between; array items without; doubles in six digits."""
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            parts.append(general(c.cast("double")))
        elif kind.startswith("array"):
            parts.append(F.array_join(c.cast("array<string>"), ""))
        else:
            parts.append(c.cast("string"))
    return F.concat_ws(" ", *parts)


def write_text(df: DataFrame, path: str, single: bool = False) -> None:
    """Records as lines in part files of a folder; single: in one part, for small results."""
    df = df.select(formatted(df).alias("value"))
    (df.coalesce(1) if single else df).write.option("lineSep", "\n").text(path)
