"""Queries of this folder and their SQL."""

from __future__ import annotations

from orbtable.llm import (
    bpe, exact_dedup, filter_audit, lm_scoring, manifest, near_dedup, packing, private_data, quality_classifier, quality_rules,
    suffix_dedup, token_counts, toxicity,
)

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_packing": packing.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_private_data": private_data.query,
    "op6_token_counts": token_counts.query,
    "op7_bpe": bpe.query,
    "op8_quality_rules": quality_rules.query,
    "op9_lm_scoring": lm_scoring.query,
    "op10_quality_classifier": quality_classifier.query,
    "op11_filter_audit": filter_audit.query,
    "op12_manifest": manifest.query,
    "op13_toxicity": toxicity.query,
}
ORACLES = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_suffix_dedup": suffix_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_manifest": manifest.SQL,
}
