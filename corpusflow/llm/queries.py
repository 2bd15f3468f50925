"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from corpusflow.llm import (ann, decontam, langid, license_scan, line_dedup, lm_score, near_dup, periodic_runs, piece_codec,
                            prefix_trie, token_counts, token_store, toxicity)

QUERIES = {
    "op1_nearest": ann.op1_nearest,
    "op2_piece_codec": piece_codec.op2_piece_codec,
    "op3_token_store": token_store.op3_token_store,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_language_id": langid.op6_language_id,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_near_duplicates": near_dup.op9_near_duplicates,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {
    "op11_prefix_trie": prefix_trie.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_near_duplicates": near_dup.SQL,
    "op10_decontaminate": decontam.SQL,
}
