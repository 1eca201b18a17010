"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from larkspan.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, sharding, token_counts, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_personal_data": pii.op2_personal_data,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_best_fit_shards": sharding.op6_best_fit_shards,
    "op7_toxic_segments": toxicity.op7_toxic_segments,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_near_duplicates": near_dedup.op10_near_duplicates,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_quality_rules": quality.OP5_SQL,
}
