"""From documents to packed sequences, in five stages; the query `pipeline`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.language_id import accepted
from quern.llm.line_dedup import line_dedup
from quern.llm.mixing import copies
from quern.llm.near_dedup import one_of_each
from quern.llm.packing import pack
from quern.llm.shared import collect, materialize, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no known language: null, without a letter, or too far from every profile."""
    return accepted(docs)


def cross_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sites share out of the texts; documents stay, and n_chars follows the text."""
    from pyspark.sql import functions as F

    df = line_dedup(docs, counts=False)
    return df.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that sources come near their target weights."""
    return copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row for each piece, with its token ids."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", cross_site_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Profiles, near-duplicate classes and tokens aren't expressible in SQL: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's docs, and deleted when that is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        read, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if i:
            release(read)
        collect(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
