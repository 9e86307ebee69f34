"""Queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from . import chat, exact_dedup, minhash, mixing, sentencepiece, substring_dedup, topk_search, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_warc": warc.op4_warc,
        "op5_sentencepiece": sentencepiece.op5_sentencepiece,
        "op6_mixing": mixing.op6_mixing,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_topk_search": topk_search.op9_topk_search,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op2_chat_formatting": chat.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op9_topk_search": topk_search.OP9_SQL,
        "op10_minhash": minhash.OP10_SQL,
    }
