"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from folio.llm import langid, media, mixing, near_dedup, pii, quality, sharding, sp_dropout, substring_dedup, token_files

QUERIES = {
    "op1_bottom_k_near_dedup": near_dedup.op1_bottom_k_near_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_bootstrapped_pii": pii.op3_bootstrapped_pii,
    "op6_golden_mix": mixing.op6_golden_mix,
    "op8_suffix_dedup": substring_dedup.op8_suffix_dedup,
    "op9_wav_fingerprints": media.op9_wav_fingerprints,
    "op10_kernel_language": langid.op10_kernel_language,
    "op4_merge_dropout": sp_dropout.op4_merge_dropout,
    "op5_stratified_shards": sharding.op5_stratified_shards,
    "op7_adaptive_quality": quality.op7_adaptive_quality,
}

ORACLE = {**mixing.ORACLE, **sharding.ORACLE, **quality.ORACLE}
