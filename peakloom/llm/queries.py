"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import op5_bm25_wand
from .huffman import op9_huffman_token_files
from .jaccard_join import OP2_SQL, op2_vertical_jaccard
from .license_scan import OP12_SQL, op12_license_templates
from .nbsvm import op7_nb_support_vectors
from .ngram_lm import op10_elias_fano_trie
from .packing import op6_best_fit_packing
from .quality_rules import OP1_SQL, op1_robust_outliers
from .quotations import OP4_SQL, op4_quotation_links
from .sharding import op3_virtual_slots
from .source_divergence import OP13_SQL, op13_source_divergence
from .suffix_dedup import OP8_SQL, op8_suffix_buckets
from .vector_codes import OP11_SQL, op11_ball_tree_codes

QUERIES = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_vertical_jaccard": op2_vertical_jaccard,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_quotation_links": op4_quotation_links,
    "op5_bm25_wand": op5_bm25_wand,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_nb_support_vectors": op7_nb_support_vectors,
    "op8_suffix_buckets": op8_suffix_buckets,
    "op9_huffman_token_files": op9_huffman_token_files,
    "op10_elias_fano_trie": op10_elias_fano_trie,
    "op11_ball_tree_codes": op11_ball_tree_codes,
    "op12_license_templates": op12_license_templates,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_robust_outliers": OP1_SQL,
    "op2_vertical_jaccard": OP2_SQL,
    "op4_quotation_links": OP4_SQL,
    "op8_suffix_buckets": OP8_SQL,
    "op11_ball_tree_codes": OP11_SQL,
    "op12_license_templates": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
