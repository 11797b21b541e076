"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import (
    decontaminate, exact_dedup, filter_audit, language_id, license_scan, merkle, near_dedup, packing, quality, sentencepiece_fst, substring_dedup, token_files, toxicity,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_sentencepiece": sentencepiece_fst.op2_sentencepiece,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_packing": packing.op12_packing,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

#: Trained models, binary files and the model of pieces have no SQL; tests hold them against brute force.
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
