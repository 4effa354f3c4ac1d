"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import divergence, exact_search, group_ranks, ngram_join, quality, sharding, substring_dedup, tool_calls
from .best_fit import op13_best_fit_packing
from .divergence import op11_source_divergence
from .exact_search import op6_kd_tree_search
from .group_ranks import op12_group_ranks
from .line_templates import op3_line_templates
from .ngram_join import op10_ngram_jaccard_join
from .packing import op5_harmonic_packing
from .quality import op4_quality_rules
from .piece_lattice import op9_piece_lattice
from .sharding import op7_permutation_sharding
from .substring_dedup import op8_substring_dedup
from .tool_calls import op2_tool_calls
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_tool_calls": op2_tool_calls,
    "op3_line_templates": op3_line_templates,
    "op4_quality_rules": op4_quality_rules,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_kd_tree_search": op6_kd_tree_search,
    "op7_permutation_sharding": op7_permutation_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_piece_lattice": op9_piece_lattice,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_group_ranks": op12_group_ranks,
    "op13_best_fit_packing": op13_best_fit_packing,
}

SQL: dict[str, str] = {
    "op2_tool_calls": tool_calls.SQL,
    "op4_quality_rules": quality.SQL,
    "op6_kd_tree_search": exact_search.SQL,
    "op7_permutation_sharding": sharding.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_ngram_jaccard_join": ngram_join.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_group_ranks": group_ranks.SQL,
}
