"""Query op8_html_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import html_text
from larkspur.llm.common import table


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))
