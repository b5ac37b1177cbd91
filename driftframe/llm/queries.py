"""The registered queries of the llm operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, jaccard, license, lm, media, packing, quality, substring, toxicity

QUERIES = {
    "op1_bpe_transducer": bpe.query,
    "op2_retrieval_packing": packing.query,
    "op3_matroska": media.query,
    "op4_substring_dedup": substring.query,
    "op5_toxicity": toxicity.query,
    "op6_chat_format": chat.query,
    "op7_fertility_rules": quality.query,
    "op8_license_scan": license.query,
    "op9_jaccard_join": jaccard.query,
    "op10_lm_score": lm.query,
}
ORACLE_SQL = {"op6_chat_format": chat.SQL, "op8_license_scan": license.sql()}
