"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, fingerprints, hard_negatives, minhash, mixing, paragraphs, quality_classifier, quality_rules, secret_scan, simhash, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    fingerprints.op1_fingerprints, quality_classifier.op2_quality_classifier, simhash.op3_simhash_near_dedup,
    paragraphs.op4_paragraph_dedup, url_filter.op5_url_filter, quality_rules.op6_quality_rules, mixing.op7_mix_sources, token_counts.op8_token_counts,
    byte_bpe.op9_byte_bpe, secret_scan.op10_secret_scan, alignment.op11_tokenizer_alignment, hard_negatives.op12_hard_negatives, minhash.op13_minhash_near_dedup)}

ORACLE_SQL: dict[str, str] = {"op7_mix_sources": mixing.oracle_sql(), "op12_hard_negatives": hard_negatives.ORACLE_SQL}
