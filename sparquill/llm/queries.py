"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import alignment, chat, exact_dedup, fill_middle, fingerprints, licenses, line_dedup, lm, mixing, near_dedup, packing, quality, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
        "op2_url_filter": url_filters.op2_url_filter,
        "op3_simhash_near_dedup": near_dedup.op3_simhash_near_dedup,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_lm_scoring": lm.op10_lm_scoring,
        "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat_formatting": chat.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op12_line_dedup": line_dedup.OP12_SQL,
        "op13_fill_in_middle": fill_middle.OP13_SQL,
    }
