"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm import chunk_dedup, decontamination, divergence, language, mixing, near_duplicates, nearest, packing, prefix_trie, quality, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_jaccard": near_duplicates.op3_jaccard,
    "op4_chunk_dedup": chunk_dedup.op4_chunk_dedup,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_nearest": nearest.op9_nearest,
    "op10_language": language.op10_language,
    "op11_divergence": divergence.op11_divergence,
    "op12_packing": packing.op12_packing,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op3_jaccard": near_duplicates.OP3_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
