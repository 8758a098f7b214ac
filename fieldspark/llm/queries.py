"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from .ann import op4_collision_ann
from .hard_negatives import op11_slot_negatives
from .minhash_dedup import op3_minhash_dedup
from .mixing import op9_cube_mixing
from .oracles import OP2_SQL, OP3_SQL, OP6_SQL, OP11_SQL, OP13_SQL
from .packing import op5_bin_completion
from .pii import op12_bootstrapped_pii
from .prefix_trie import op13_prefix_trie
from .quality import op7_ordinal_quality
from .quality_rules import op6_divergence_rules
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op1_suffix_array_dedup
from .toxicity import op8_counterfactual_toxicity
from .url_filter import op10_boosted_urls

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_collision_ann": op4_collision_ann,
    "op5_bin_completion": op5_bin_completion,
    "op6_divergence_rules": op6_divergence_rules,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
    "op9_cube_mixing": op9_cube_mixing,
    "op10_boosted_urls": op10_boosted_urls,
    "op11_slot_negatives": op11_slot_negatives,
    "op12_bootstrapped_pii": op12_bootstrapped_pii,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_minhash_dedup": OP3_SQL,
    "op6_divergence_rules": OP6_SQL,
    "op11_slot_negatives": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
