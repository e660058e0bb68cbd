"""Query op11_lm_scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import katz
from larkspur.llm.common import table


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), order=2).scores
