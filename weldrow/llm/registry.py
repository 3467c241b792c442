"""The subpackage's queries and the SQL that they are checked against."""

from __future__ import annotations

from weldrow.llm import bpe, exact_dedup, langid, packing, quality, shuffling, simhash, url_filter, vectors, warc

QUERIES = {
    "op1_revisit_asof": warc.op1_revisit_asof,
    "op2_tree_merge_dedup": exact_dedup.op2_tree_merge_dedup,
    "op3_ftrl_quality": quality.op3_ftrl_quality,
    "op4_simhash_bk": simhash.op4_simhash_bk,
    "op5_bloom_langid": langid.op5_bloom_langid,
    "op6_window_packing": packing.op6_window_packing,
    "op7_link_graph": url_filter.op7_link_graph,
    "op8_two_pass_shuffle": shuffling.op8_two_pass_shuffle,
    "op9_folded_bpe": bpe.op9_folded_bpe,
    "op10_itq_vectors": vectors.op10_itq_vectors,
}
ORACLES = {
    "op1_revisit_asof": warc.ORACLE,
    "op2_tree_merge_dedup": exact_dedup.ORACLE,
    "op7_link_graph": url_filter.oracle(),
}
