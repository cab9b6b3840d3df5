"""Bytes of files as Python sees them, for what Spark's own readers and writers can't do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, bytes) of every file of the paths, folders searched through; only names that begin with a dot are left out.

    Spark's own listing leaves out names that begin with an underscore as well. A missing path is an error. One row for
    each file comes to the driver, as for Spark's listing.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, int]] = []

    def walk(fs, status, top: bool) -> None:
        path = status.getPath()
        if not top and path.getName().startswith("."):
            return
        if status.isDirectory():
            for child in sorted(fs.listStatus(path), key=lambda s: s.getPath().toString()):
                walk(fs, child, False)
        else:
            out.append((path.toString(), status.getLen()))

    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        walk(fs, fs.getFileStatus(path), True)
    return out


def opened(path: str):
    """(file system, path in it) of pyarrow for a path with or without a scheme; an error where it knows no such store."""
    from pyarrow import fs

    if path.startswith("file:"):  # Hadoop writes file:/x for file:///x
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
