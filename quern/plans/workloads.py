"""Word count, with and without an opaque combiner, over any texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.kv import KVDataset


def words(texts: DataFrame, text: str = "text") -> DataFrame:
    """word: every token of every line."""
    return texts.select(F.explode(tokens(F.translate(F.col(text), "\n", " "))).alias("word"))


def word_count(texts: DataFrame, text: str = "text") -> DataFrame:
    return words(texts, text).groupBy("word").agg(F.count("*").alias("cnt"))


def word_count_combined(texts: DataFrame, text: str = "text") -> DataFrame:
    """The same as key/value records (word, 1), whose values a combiner adds before and after the shuffle."""
    ones = KVDataset(words(texts, text).withColumn("cnt", F.lit(1).cast("long")), ("word",))
    return ones.combine_columns(cnt=F.sum("cnt")).df
