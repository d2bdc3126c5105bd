"""Queries of this subpackage, and their SQL where SQL can express them."""

from clauseloom.llm import bpe, doc_fingerprints, licenses, mixing, near_dedup, quality, secrets, sharding, suffix_dedup, token_counts

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_bpe_tree": bpe.op4_bpe_tree,
    "op5_repeated_passages": suffix_dedup.op5_repeated_passages,
    "op6_shard_splitters": sharding.op6_shard_splitters,
    "op7_doc_fingerprints": doc_fingerprints.op7_doc_fingerprints,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_simhash_dedup": near_dedup.op9_simhash_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLES = {
    "op2_secret_scan": secrets.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
