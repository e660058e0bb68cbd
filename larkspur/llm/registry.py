"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import q_centroids, q_decontaminate, q_html_text, q_jaccard, q_katz, q_licenses, q_pieces, q_quality, q_quotes, q_repeats, q_token_files, q_url_filter, q_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": q_decontaminate.op1_decontamination,
        "op2_quality_rules": q_quality.op2_quality_rules,
        "op3_license_scan": q_licenses.op3_license_scan,
        "op4_sentencepiece": q_pieces.op4_sentencepiece,
        "op5_token_counts": q_token_files.op5_token_counts,
        "op6_suffix_dedup": q_repeats.op6_suffix_dedup,
        "op7_url_filters": q_url_filter.op7_url_filters,
        "op8_html_text": q_html_text.op8_html_text,
        "op9_chat_quotes": q_quotes.op9_chat_quotes,
        "op10_jaccard_join": q_jaccard.op10_jaccard_join,
        "op11_lm_scores": q_katz.op11_lm_scores,
        "op12_whitening": q_whitening.op12_whitening,
        "op13_centroid_clusters": q_centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": q_decontaminate.SQL,
        "op2_quality_rules": q_quality.SQL,
        "op6_suffix_dedup": q_repeats.SQL,
        "op7_url_filters": q_url_filter.SQL,
        "op9_chat_quotes": q_quotes.SQL,
        "op10_jaccard_join": q_jaccard.SQL,
        "op13_centroid_clusters": q_centroids.SQL,
    }
