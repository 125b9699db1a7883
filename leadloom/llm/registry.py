"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audio, chat, interactions, licenses, mixing, oracles, order_minhash, packing, quality, ranked, secrets, simhash, substrings, urls

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_media_columns": audio.op3_media_columns,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_mixing_sources": mixing.op6_mixing_sources,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_url_filters": urls.op9_url_filters,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_document_fingerprints": order_minhash.op11_document_fingerprints,
    "op12_ranked_lexical_search": ranked.op12_ranked_lexical_search,
    "op13_filter_interaction_audit": interactions.op13_filter_interaction_audit,
}

ORACLES = {
    "op1_chat_formatting": chat.ORACLE_1,
    "op2_secret_scans": oracles.ORACLE_2,
    "op4_substring_dedup": oracles.ORACLE_4,
    "op5_quality_rules": oracles.ORACLE_5,
    "op6_mixing_sources": mixing.ORACLE_6,
    "op8_license_scans": licenses.ORACLE_8,
    "op9_url_filters": urls.ORACLE_9,
    "op12_ranked_lexical_search": ranked.ORACLE_12,
    "op13_filter_interaction_audit": interactions.ORACLE_13,
}
