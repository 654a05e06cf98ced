"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, centroids, decontamination, divergence, exact_dedup, html_text, langid, near_dedup, pii, quality, rules, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality_rules": rules.op2_quality_rules,
    "op3_pii": pii.op3_pii,
    "op4_language_id": langid.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_html_extraction": html_text.op10_html_extraction,
    "op11_divergence": divergence.op11_divergence,
    "op12_centroids": centroids.op12_centroids,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rules.ORACLE_SQL,
    "op7_near_dedup": near_dedup.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
    "op13_exact_dedup": exact_dedup.ORACLE_SQL,
}
