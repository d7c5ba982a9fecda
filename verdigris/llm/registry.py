"""The queries of this folder and their SQL."""

from __future__ import annotations

from verdigris.llm import bpe_codec, chat, decontaminate, html_text, language_id, lexical, line_dedup, quality, simhash, token_count, token_file, topk, whiten

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_decontaminate": decontaminate.query,
    "op3_topk": topk.query,
    "op4_token_file": token_file.query,
    "op5_bpe_codec": bpe_codec.query,
    "op6_line_dedup": line_dedup.query,
    "op7_quality": quality.query,
    "op8_html_text": html_text.query,
    "op9_language_id": language_id.query,
    "op10_token_count": token_count.query,
    "op11_lexical": lexical.query,
    "op12_whiten": whiten.query,
    "op13_chat": chat.query,
}
ORACLES = {"op3_topk": topk.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op11_lexical": lexical.ORACLE}
