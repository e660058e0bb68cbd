"""Query op3_license_scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import licenses
from larkspur.llm.common import table


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))
