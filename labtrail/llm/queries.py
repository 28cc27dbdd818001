"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from labtrail.llm import embedding_dedup, hard_negatives, licenses, mixing, neighbours, pieces, pii, prefix_trie, quality, simhash, substring_dedup, tokens, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup,
        embedding_dedup.op2_embedding_near_dedup,
        tokens.op3_token_counts,
        neighbours.op4_nearest_neighbours,
        pii.op5_pii,
        pieces.op6_sentencepiece,
        mixing.op7_mix_sources,
        simhash.op8_simhash_near_dedup,
        url_filter.op9_url_filter,
        quality.op10_quality_classifier,
        prefix_trie.op11_conversation_trie,
        hard_negatives.op12_hard_negatives,
        licenses.op13_license_scan,
    )
}
SQL = {
    "op7_mix_sources": mixing.OP7_SQL,
    "op11_conversation_trie": prefix_trie.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_license_scan": licenses.OP13_SQL,
}
