"""Query op5_token_counts: documents as flat token files, then counted from the files alone."""

from __future__ import annotations

import base64
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import token_files as t
from larkspur.llm.common import discard_folder, materialize, scratch, table

#: A public vocabulary of byte ranks and its word pattern; the same place on every machine. 50256 is free: it ends documents.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50_256
#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder():
    one = encoding()
    return lambda texts: [one.encode_ordinary(x) for x in texts]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every row of documents."""
    folder = scratch(spark, "tokens")
    names = materialize(t.write(table(spark, sf_dir, "documents"), folder, encoder, "uint16", END), "names")
    files = names.groupBy("path").agg(F.max("size").alias("size"))
    blocks = t.blocks_of(spark, files, 2)
    found = materialize(t.scanned(t.dealt(blocks), "uint16", END), "blocks")
    discard_folder(spark, folder)
    return names.join(t.counts(blocks, found).hint("merge"), ["path", "doc"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
