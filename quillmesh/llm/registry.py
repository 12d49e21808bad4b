"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillmesh.llm import decontam, html_extract, langid, ngram_join, packing, pii, quality, sharding, suffix_dedup, topk

QUERIES = {
    "op1_ordinal": quality.op1_ordinal,
    "op2_postings": decontam.op2_postings,
    "op3_bin_completion": packing.op3_bin_completion,
    "op4_blocked_product": ngram_join.op4_blocked_product,
    "op5_tree_scoring": html_extract.op5_tree_scoring,
    "op6_loser_trees": suffix_dedup.op6_loser_trees,
    "op7_ring": sharding.op7_ring,
    "op8_mtree": topk.op8_mtree,
    "op9_bigru": langid.op9_bigru,
    "op10_boosted": pii.op10_boosted,
}

ORACLE_SQL = {
    "op2_postings": decontam.SQL_OP2,
    "op4_blocked_product": ngram_join.SQL_OP4,
    "op5_tree_scoring": html_extract.SQL_OP5,
    "op8_mtree": topk.SQL_OP8,
}
