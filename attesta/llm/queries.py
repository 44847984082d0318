"""Queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from attesta.llm import byte_spans, decontaminate, language_id, line_dedup, near_dedup, pieces, quality, topk, url_filter, word_windows

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_suffix_dedup": byte_spans.op3_suffix_dedup,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_top_k": topk.op6_top_k,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_substring_dedup": word_windows.op9_substring_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
}
SQL = {"op1_line_dedup": line_dedup.OP1_SQL, "op3_suffix_dedup": byte_spans.OP3_SQL, "op5_near_dedup": near_dedup.OP5_SQL, "op6_top_k": topk.OP6_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op9_substring_dedup": word_windows.OP9_SQL, "op10_url_filter": url_filter.OP10_SQL}
