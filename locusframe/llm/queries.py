"""The queries of this subpackage, for the registry."""

from __future__ import annotations

from . import bpe, chat, embedding_join, language, licenses, mixing, near_duplicates, phrases, quality, repeats, resampling, token_blocks, url_filter

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_language_id": language.op2_language_id,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_jaccard_join": near_duplicates.op4_jaccard_join,
    "op5_embedding_join": embedding_join.op5_embedding_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_token_blocks": token_blocks.op7_token_blocks,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_resample": resampling.op11_resample,
    "op12_collocations": phrases.op12_collocations,
    "op13_substring_dedup": repeats.op13_substring_dedup,
}
ORACLE_SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_substring_dedup": repeats.OP13_SQL,
}
