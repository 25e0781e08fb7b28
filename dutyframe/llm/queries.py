"""The registered queries of the corpus operators and their SQL equivalents."""

from __future__ import annotations

from dutyframe.llm import chat_format, decontamination, filter_audit, language_id, license_scan, minhash, mixing, prefix_trie, sharding, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_jump_hash_sharding": sharding.op2_jump_hash_sharding,
    "op3_bbit_minhash": minhash.op3_bbit_minhash,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_compression_toxicity": toxicity.op5_compression_toxicity,
    "op6_pivotal_mixing": mixing.op6_pivotal_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_lcp_merge_dedup": suffix_dedup.op8_lcp_merge_dedup,
    "op9_simhash_decontamination": decontamination.op9_simhash_decontamination,
    "op10_simhash_fingerprints": simhash.op10_simhash_fingerprints,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_chat_round_trip": chat_format.op13_chat_round_trip,
}
ORACLES = {
    "op2_jump_hash_sharding": sharding.ORACLE,
    "op3_bbit_minhash": minhash.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op8_lcp_merge_dedup": suffix_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_chat_round_trip": chat_format.ORACLE,
}
