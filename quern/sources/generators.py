"""Seeded synthetic data: keys, Zipf words and 3-D points. Rows depend on the seed and their index alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import ALPHABET, index_word
from quern.operators.scans import numbered


def uniform(index: Column, seed: int, salt: str = "") -> Column:
    """A number in [0, 1) for each index, by a hash, so that reruns and layouts agree."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), index), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(index: Column, seed: int, salt: str = "") -> Column:
    """A standard normal number for each index (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(index, seed, salt + "r"))) * F.cos(2 * F.pi() * uniform(index, seed, salt + "a"))


def random_words(index: Column, seed: int, mean: int = 6, deviation: int = 1) -> Column:
    """A word for each index of a length within three deviations of the mean, letters and digits alike likely."""
    low, high = max(1, mean - 3 * deviation), mean + 3 * deviation
    length = (F.lit(low) + F.floor(uniform(index, seed, "length") * (high - low + 1))).cast("int")
    sign = lambda k: F.substring(F.lit(ALPHABET), (F.floor(F.pmod(F.xxhash64(F.lit(seed), k, index), F.lit(62))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), length), sign), "")


def unique_keys(spark: SparkSession, n: int, seed: int = 0, mean: int = 6, deviation: int = 1) -> DataFrame:
    """idx, word: n distinct words. Twice as many candidates are drawn as are missing until there are enough."""
    drawn = n + 16
    while True:
        words = spark.range(drawn).select("id", random_words(F.col("id"), seed, mean, deviation).alias("word")).groupBy("word").agg(F.min("id").alias("id"))
        if (found := words.count()) >= n:
            break
        if drawn > 64 * n + 4096:
            raise ValueError(f"only {found} distinct words of this length were found")
        drawn += 2 * (n - found) + 16
    return numbered(words, "id").where(F.col("idx") < n).select("idx", "word")


def zipf_weights(spark: SparkSession, n: int, alpha: float) -> DataFrame:
    """rank (from 1), weight 1 / rank ** alpha, and the cumulative share up to and including it."""
    w = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.pow(F.col("id").cast("double"), F.lit(-float(alpha))).alias("weight"))
    up = F.sum("weight").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return w.select("rank", "weight", (up / F.sum("weight").over(Window.partitionBy())).alias("cdf"))


def zipf_ranks(cdf: Sequence[float], u: Column) -> Column:
    """The rank whose span of the cumulative shares holds u: cdf[r - 1] <= u < cdf[r]. cdf is a dictionary's, so small."""
    edges = np.asarray(cdf, dtype=float)

    @F.pandas_udf("long")
    def rank(x: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(edges, x.to_numpy(), side="right"), len(edges) - 1) + 1)

    return rank(u)


def zipf_words(
    spark: SparkSession, items: int, n: int, alpha: float, seed: int = 0, value_length: int | None = None, mean: int = 5, deviation: int = 0,
    heavy: float = 0.0, indexed: bool = False, exchange: bool = False,
) -> DataFrame:
    """idx, word (and value): items words of a dictionary of n, of which the r-th is drawn in proportion to 1 / r ** alpha.

    heavy: the share of items that are the first word, whatever is drawn. indexed: words are their number in base 62 (of
    mean digits) rather than random signs. exchange: rows come in a seeded order, not in that of their numbers.
    """
    cdf = [r.cdf for r in zipf_weights(spark, n, alpha).orderBy("rank").collect()]  # n numbers, of the dictionary
    if indexed:
        words = spark.range(n).select(F.col("id").alias("idx"), index_word(F.col("id"), mean).alias("word"))
    else:
        words = unique_keys(spark, n, seed, mean, deviation)
    idx = zipf_ranks(cdf, uniform(F.col("id"), seed, "zipf")) - 1
    drawn = spark.range(items).select("id", F.when(uniform(F.col("id"), seed, "heavy") < heavy, F.lit(0)).otherwise(idx).cast("long").alias("idx"))
    out = drawn.join(words, "idx").select(F.col("id").alias("idx"), "word")
    if value_length:
        low = 10 ** (value_length - 1)
        out = out.withColumn("value", (F.lit(low) + F.floor(uniform(F.col("idx"), seed, "value") * (10**value_length - low))).cast("long"))
    return shuffled(out, seed) if exchange else out


def word_stats(words: DataFrame) -> DataFrame:
    """word, cnt of each distinct word: the generator's statistics file, and the second side of a join with its words."""
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def histogram(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, cnt for each word of the dictionary, 0 where words have none."""
    found = words.groupBy("word").agg(F.count("*").alias("cnt"))
    return dictionary.select("word").join(found, "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def points(spark: SparkSession, n: int, seed: int = 0, center: Sequence[float] = (0.0, 0.0, 0.0), deviation: float | None = 0.5) -> DataFrame:
    """idx, x, y, z: normal around the center, or (deviation None) uniform over the cube from -4 to 4."""
    one = lambda c, name: (normal(F.col("id"), seed, name) * deviation + c) if deviation is not None else uniform(F.col("id"), seed, name) * 8 - 4
    return spark.range(n).select(F.col("id").alias("idx"), *[one(c, name).alias(name) for c, name in zip(center, "xyz", strict=True)])


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """df in an order that the seed and the rows decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))


def point_lines(points_: DataFrame) -> DataFrame:
    """value: ` x y z`, coordinates in 17 places behind the point, of rows (x, y, z)."""
    return points_.select(F.concat(*[F.format_string(" %.17f", F.col(c)) for c in "xyz"]).alias("value"))
