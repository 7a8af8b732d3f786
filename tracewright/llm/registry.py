"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, chat_format, decontaminate, fill_in_middle, html_text, licenses, ngram_join, periodic_runs, quality_rules, secrets, sharding, token_output, url_filters

OPERATORS = {
    "op1_url_filters": url_filters,
    "op2_license_scans": licenses,
    "op3_sharding": sharding,
    "op4_quality_rules": quality_rules,
    "op5_bpe": bpe,
    "op6_html_extraction": html_text,
    "op7_ngram_jaccard_join": ngram_join,
    "op8_token_output": token_output,
    "op9_secret_scans": secrets,
    "op10_benchmark_decontamination": decontaminate,
    "op11_chat_formatting": chat_format,
    "op12_periodic_runs": periodic_runs,
    "op13_fill_in_middle": fill_in_middle,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in OPERATORS.items()} | {"quality_ablation": quality_rules.ablation_query}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in OPERATORS.items() if module.ORACLE} | {"quality_ablation": quality_rules.ABLATION_ORACLE}
