"""The queries of this subpackage and their SQL; a query without SQL is tested against a brute-force version."""

from __future__ import annotations

from tarn.llm import decontaminate, exact, lines, mixing, quality, secrets, simhash, suffix, toxicity, urls


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_exact_dedup": exact.op3_exact_dedup,
        "op4_suffix_dedup": suffix.op4_suffix_dedup,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_url_filter": urls.op8_url_filter,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.SQL,
        "op3_exact_dedup": exact.SQL,
        "op8_url_filter": urls.SQL,
        "op9_secret_scan": secrets.SQL,
    }
