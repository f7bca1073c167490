"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from lexspark.llm import (
    chat, exact_dedup, fingerprints, minhash, packing, quality_classifier, quality_rules, ranked_search, sentence_pieces, substrings,
    toxicity, vector_codes, warc
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_sentencepiece": sentence_pieces.op2_sentencepiece,
    "op3_warc": warc.op3_warc,
    "op4_packing": packing.op4_packing,
    "op5_chat_prefix_tree": chat.op5_chat_prefix_tree,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_minhash_dedup": minhash.op8_minhash_dedup,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL, "op9_substring_dedup": substrings.ORACLE_SQL, "op11_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_ranked_search": ranked_search.ORACLE_SQL
}
