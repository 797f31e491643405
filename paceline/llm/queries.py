"""The operators' queries and, where SQL can express them, their DuckDB SQL."""

from . import bpe, decontamination, exact_dedup, html_text, language_id, licenses, near_dedup, pii, prefix_trie, sharding, simhash, toxicity, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_bpe": bpe.op4_bpe,
    "op5_sharding": sharding.op5_sharding,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_language_id": language_id.op7_language_id,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_html_text": html_text.op9_html_text,
    "op10_pii": pii.op10_pii,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_simhash": simhash.op13_simhash,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op5_sharding": sharding.oracle(),
    "op12_prefix_trie": prefix_trie.ORACLE,
}
