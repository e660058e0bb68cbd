"""Query op12_whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import whitening
from larkspur.llm.common import table


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
