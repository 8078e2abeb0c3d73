"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from palimpsest.llm import chat, conversation_repair, exact_dedup, html_text, langid, mixing, near_join, packing, pii, quality, spelling, topk, url_filter

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_exact_topk": topk.op2_exact_topk,
    "op3_mixing": mixing.op3_mixing,
    "op4_langid": langid.op4_langid,
    "op5_pii": pii.op5_pii,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_ngram_join": near_join.op9_ngram_join,
    "op10_packing": packing.op10_packing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op2_exact_topk": topk.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_chat_formatting": chat.SQL,
    "op9_ngram_join": near_join.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_url_filter": url_filter.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
