"""Queries opN_<name> of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from docloom.llm import ann, binary_output, bpe, exact_dedup, license_scan, near_dedup, packing, personal_data, quality, token_counts, url_filter, vector_codes, whitening


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_nearest": ann.op3_nearest,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_token_files": binary_output.op5_token_files,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_quality": quality.op8_quality,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_whitening": whitening.op12_whitening,
        "op13_personal_data": personal_data.op13_personal_data,
    }


def oracle_sql() -> dict:
    return {
        "op6_exact_dedup": exact_dedup.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
    }
