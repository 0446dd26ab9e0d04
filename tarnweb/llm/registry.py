"""Queries of the training-data operators and their SQL, where there is any."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, forest, infill, mixing, pii, quality, ranking, sharding, suffixes, token_counts, token_files

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_quality_classifier": quality.query,
    "op3_token_counts": token_counts.query,
    "op4_personal_data": pii.query,
    "op5_token_files": token_files.query,
    "op6_chat_format": chat.query,
    "op7_decontaminate": decontaminate.query,
    "op8_fingerprints": fingerprints.query,
    "op9_suffix_dedup": suffixes.query,
    "op10_jaccard_join": forest.query,
    "op11_ranked_search": ranking.query,
    "op12_shards": sharding.query,
    "op13_infill": infill.query,
}

SQL = {"op1_mix_sources": mixing.SQL, "op7_decontaminate": decontaminate.SQL, "op11_ranked_search": ranking.SQL}
