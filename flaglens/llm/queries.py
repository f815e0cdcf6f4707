"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from flaglens.llm import bagminhash, decontaminate, mixing, pii, secrets, site_tree, token_counts, token_file, toxicity, vafile

QUERIES = {
    "op1_token_file": token_file.query,
    "op2_site_tree": site_tree.query,
    "op3_pii": pii.query,
    "op4_secrets": secrets.query,
    "op5_decontamination": decontaminate.query,
    "op6_vafile": vafile.query,
    "op7_bagminhash": bagminhash.query,
    "op8_token_counts": token_counts.query,
    "op9_toxicity": toxicity.query,
    "op10_mixing": mixing.query,
}

ORACLES = {
    "op6_vafile": vafile.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
