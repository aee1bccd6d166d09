"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, chat_repair, decontaminate, divergence, fingerprint, html_text, jaccard_join, lm_score, mixing, quality, substring_dedup, toxicity, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprint.op1_fingerprints,
        "op2_url_filters": url_rules.op2_url_filters,
        "op3_lm_scoring": lm_score.op3_lm_scoring,
        "op4_html_extraction": html_text.op4_html_extraction,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_chat_formatting": chat_format.op6_chat_formatting,
        "op7_mixing": mixing.op7_mixing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
        "op11_quality_classifier": quality.op11_quality_classifier,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_conversation_repair": chat_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": url_rules.OP2_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op6_chat_formatting": chat_format.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op9_jaccard_join": jaccard_join.OP9_SQL,
        "op10_benchmark_decontamination": decontaminate.OP10_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
