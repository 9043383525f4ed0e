"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, html, langid, line_dedup, near_dup, quality, substrings, token_counts, urls

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_decontamination": decontaminate.query,
    "op3_html_extraction": html.query,
    "op4_near_dedup": near_dup.query,
    "op5_language_id": langid.query,
    "op6_byte_bpe": bpe.query,
    "op7_substring_dedup": substrings.query,
    "op8_token_counts": token_counts.query,
    "op9_quality_rules": quality.query,
    "op10_url_filters": urls.query,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_decontamination": decontaminate.SQL,
    "op4_near_dedup": near_dup.SQL,
    "op7_substring_dedup": substrings.SQL,
    "op9_quality_rules": quality.SQL,
    "op10_url_filters": urls.SQL,
}
