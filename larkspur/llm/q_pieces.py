"""Query op4_sentencepiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import pieces
from larkspur.llm.common import table

#: Where public tokenizer files lie; the same place on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), MODEL)
