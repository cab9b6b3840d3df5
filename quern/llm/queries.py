"""This package's queries and the SQL that tests them, for the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import language_id, line_dedup, mixing, near_dedup, neighbours, packing, quality_classifier, quality_rules, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

#: The others can't be told in SQL (learned models, tokenizers, seeded orders) and are tested against brute force.
ORACLES: dict[str, str] = {"op4_line_dedup": line_dedup.ORACLE, "op7_quality_rules": quality_rules.ORACLE}
