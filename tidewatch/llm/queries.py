"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from tidewatch.llm import brown_lm, decontamination, fast_sketches, jaccard_join, line_dedup, mixing, pivot_search, prefix_trie, sharding, substring_dedup, term_pipeline, token_files, toxicity

QUERIES = {
    "op1_jaccard_join": jaccard_join.query,
    "op2_pareto_mix": mixing.query,
    "op3_ring_shards": sharding.query,
    "op4_simple8b_tokens": token_files.query,
    "op5_brown_lm": brown_lm.query,
    "op6_pivot_search": pivot_search.query,
    "op7_fuzzy_lines": line_dedup.query,
    "op8_decontaminate": decontamination.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_noisy_channel_toxicity": toxicity.query,
    "op11_fast_sketches": fast_sketches.query,
    "op12_term_pipeline": term_pipeline.query,
    "op13_prefix_trie": prefix_trie.query,
}
ORACLES = {
    "op1_jaccard_join": jaccard_join.ORACLE_SQL,
    "op2_pareto_mix": mixing.ORACLE_SQL,
    "op6_pivot_search": pivot_search.ORACLE_SQL,
    "op8_decontaminate": decontamination.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_fast_sketches": fast_sketches.ORACLE_SQL,
    "op12_term_pipeline": term_pipeline.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
