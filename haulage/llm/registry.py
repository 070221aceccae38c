"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from haulage.llm import (chat, decontaminate, embeddings, langid, language_model, lines, minhash, mixing, sharding,
                         spelling, substrings, token_alignment, toxicity)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_embedding_dedup": embeddings.op4_embedding_dedup,
    "op5_minhash": minhash.op5_minhash,
    "op6_chat": chat.op6_chat,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": langid.op8_language_id,
    "op9_sharding": sharding.op9_sharding,
    "op10_lm_scoring": language_model.op10_lm_scoring,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_substring_dedup": substrings.op13_substring_dedup,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op4_embedding_dedup": embeddings.OP4_SQL,
    "op6_chat": chat.OP6_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_substring_dedup": substrings.OP13_SQL,
}
