"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from . import ann, chat, html_text, line_dedup, mixing, near_vectors, ngram_join, packing, personal_data, quality

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_html_text": html_text.op4_html_text,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat_format": chat.op6_chat_format,
    "op7_quality": quality.op7_quality,
    "op8_near_embeddings": near_vectors.op8_near_embeddings,
    "op9_packing": packing.op9_packing,
    "op10_personal_data": personal_data.op10_personal_data,
}

ORACLES = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_near_embeddings": near_vectors.OP8_SQL,
}
