"""The registered queries of this package and, where SQL can express one, its
DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinkspark.llm import bpe_queries, chat_queries, decontamination_queries, html_queries, near_queries, phrase_queries, private_queries, quality_queries, runs_queries, substring_queries, token_queries, url_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_queries.op1_url_filters,
    "op2_decontamination": decontamination_queries.op2_decontamination,
    "op3_substring_dedup": substring_queries.op3_substring_dedup,
    "op4_near_dedup": near_queries.op4_near_dedup,
    "op5_token_store": token_queries.op5_token_store,
    "op6_html_extraction": html_queries.op6_html_extraction,
    "op7_bpe_codec": bpe_queries.op7_bpe_codec,
    "op8_token_counts": token_queries.op8_token_counts,
    "op9_quality_rules": quality_queries.op9_quality_rules,
    "op10_chat_formatting": chat_queries.op10_chat_formatting,
    "op11_phrase_mining": phrase_queries.op11_phrase_mining,
    "op12_periodic_runs": runs_queries.op12_periodic_runs,
    "op13_private_data": private_queries.op13_private_data,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination_queries.SQL,
    "op9_quality_rules": quality_queries.SQL,
    "op10_chat_formatting": chat_queries.SQL,
    "op11_phrase_mining": phrase_queries.SQL,
}
