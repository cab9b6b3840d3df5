"""Equi-joins: plain, for skewed keys, and by a small side; existence and its absence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import heavy_keys


def inner(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Every pair of rows of equal keys, left columns first. Null keys meet nothing."""
    return left.join(right, key, how)


def split(left: DataFrame, right: DataFrame, key: str, parts: int = 8, fans: int = 16, seed: int = 0) -> DataFrame:
    """inner, with the left's heavy keys split: their rows go to `fans` salts, which the right's rows of those keys repeat.

    Keys are heavy by the rule of heavy_keys for `parts`; of these there are fewer than parts / 0.8, so the list is
    broadcast. Other keys have one salt. Salts are drawn row by row, so that equal rows get different ones.
    """
    heavy = F.broadcast(heavy_keys(left, key, parts).select(F.col(key).alias("heavy_key")))
    salt = F.when(F.col("heavy_key").isNotNull(), F.floor(F.rand(seed) * fans)).otherwise(F.lit(0)).cast("int")
    a = left.alias("l").join(heavy, F.col(f"l.`{key}`") == F.col("heavy_key"), "left").select("l.*", salt.alias("quern_salt"))
    salts = F.when(F.col("heavy_key").isNotNull(), F.sequence(F.lit(0), F.lit(fans - 1))).otherwise(F.array(F.lit(0)))
    b = right.alias("r").join(heavy, F.col(f"r.`{key}`") == F.col("heavy_key"), "left").select("r.*", F.explode(salts).alias("quern_salt"))
    return a.join(b, [key, "quern_salt"]).drop("quern_salt")


def with_small(large: DataFrame, small: DataFrame, key: str, most_rows: int = 1_000_000, most_bytes: int = 64_000_000) -> DataFrame:
    """inner, with the small side sent to all tasks if it has most_rows and most_bytes (as JSON) at most, else a shuffled join.

    The size is measured, over one row beyond the bound at most.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))
    n = small.limit(most_rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return large.join(F.broadcast(small) if n.rows <= most_rows and n.bytes <= most_bytes else small, key)


def having(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key the right has."""
    return left.join(right, key, "left_semi")


def lacking(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key the right lacks; rows with a null key stay."""
    return left.join(right, key, "left_anti")


def union_all(*inputs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, inputs)
