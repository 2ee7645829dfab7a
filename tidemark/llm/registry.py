"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio, jaccard, language, mixing, ordering, packing, substrings, suffixes, vectors, wrappers

QUERIES = {
    "op1_html_text": wrappers.query,
    "op2_language_id": language.query,
    "op3_audio_features": audio.query,
    "op4_jaccard_join": jaccard.query,
    "op5_pack": packing.query,
    "op6_suffix_dedup": suffixes.query,
    "op7_substring_dedup": substrings.query,
    "op8_mix_sources": mixing.query,
    "op9_training_order": ordering.query,
    "op10_embedding_dedup": vectors.query,
}

ORACLE_SQL = {"op8_mix_sources": mixing.SQL}
