"""Grouping: all of it partial before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """One row for each key, values combined by the aggregates given by name."""
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in values.items()])


def count_by(df: DataFrame, keys: list[str], above: int | None = None) -> DataFrame:
    """keys, cnt; with above, only keys of more rows than that."""
    out = df.groupBy(*keys).agg(F.count("*").alias("cnt"))
    return out if above is None else out.where(F.col("cnt") > above)


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def count_distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """n: the number of distinct keys, exactly. The keys are made distinct by a shuffle, then counted."""
    return distinct_keys(df, keys).agg(F.count("*").alias("n"))


def reduce_above_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n: how many of a key's values are above their mean; two passes over the values, as a reducer may make.

    The mean comes from a partial aggregation that is joined back, so that a key's values never meet in one task.
    """
    mean = df.groupBy(key).agg(F.avg(value).alias("mean"))
    return df.join(mean, key).groupBy(key).agg(F.sum((F.col(value) > F.col("mean")).cast("long")).alias("n"))


def local_reduce(df: DataFrame, keys: list[str], **values: tuple[str, str]) -> DataFrame:
    """part, keys and values (name=(column, "sum", "min" or "max")) of each partition's groups, without any exchange.

    Keys may come out of several partitions; part is the partition. Batches are reduced as they come, so that a task
    holds a row for each of its keys and no group's rows. Null keys are groups too.
    """
    how = {name: kind for name, (_, kind) in values.items()}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(["part int", *[f"`{k}` {kinds[k]}" for k in keys], *[f"`{n}` {kinds[c]}" for n, (c, _) in values.items()]])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            new = pdf.rename(columns={c: n for n, (c, _) in values.items()})
            held = (new if held is None else pd.concat([held, new])).groupby(keys, dropna=False, as_index=False).agg(how)
        if held is not None:
            yield held.assign(part=TaskContext.get().partitionId())

    columns = [F.col(f"`{k}`") for k in keys] + [F.col(f"`{c}`") for c, _ in values.values()]
    return df.select(*columns).mapInPandas(each, schema)
