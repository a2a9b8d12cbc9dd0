"""Queries of this subpackage and their DuckDB text, by name."""

from __future__ import annotations

from murmurscape.llm import best_fit_pack, chat_format, decontaminate, extendible_dedup, fingerprint, hard_negatives, jaccard_join, language_mixture, log_bilinear, merkle_manifest, quality_rank, secret_scan, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_language_mixture": language_mixture.op4_language_mixture,
    "op5_log_bilinear": log_bilinear.op5_log_bilinear,
    "op6_quality_rank": quality_rank.op6_quality_rank,
    "op7_best_fit_pack": best_fit_pack.op7_best_fit_pack,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_exact_dedup": extendible_dedup.op12_exact_dedup,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
ORACLES = {
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_exact_dedup": extendible_dedup.ORACLE,
    "op13_merkle_manifest": merkle_manifest.ORACLE,
}
