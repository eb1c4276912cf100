"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, line_dedup, minhash, mixing, ngram_join, packing, pii, substring_dedup, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_exact_topk": topk.op2_exact_topk,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_mixing": mixing.op4_mixing,
        "op5_warc": warc.op5_warc,
        "op6_pii": pii.op6_pii,
        "op7_language_id": language_id.op7_language_id,
        "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
        "op9_document_fingerprints": minhash.op9_document_fingerprints,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op2_exact_topk": topk.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op5_warc": warc.ORACLE,
    }
