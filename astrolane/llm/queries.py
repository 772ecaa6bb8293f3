"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from astrolane.llm import op1_warc_index, op2_token_counts, op3_piece_codec, op4_secret_scans, op5_exact_dedup, op6_quality_rules, op7_jaccard_join, op8_language_id, op9_best_fit_packing, op10_sharding


def queries() -> dict:
    return {
        "op1_warc_index": op1_warc_index.op1_warc_index,
        "op2_token_counts": op2_token_counts.op2_token_counts,
        "op3_piece_codec": op3_piece_codec.op3_piece_codec,
        "op4_secret_scans": op4_secret_scans.op4_secret_scans,
        "op5_exact_dedup": op5_exact_dedup.op5_exact_dedup,
        "op6_quality_rules": op6_quality_rules.op6_quality_rules,
        "op7_jaccard_join": op7_jaccard_join.op7_jaccard_join,
        "op8_language_id": op8_language_id.op8_language_id,
        "op9_best_fit_packing": op9_best_fit_packing.op9_best_fit_packing,
        "op10_jump_sharding": op10_sharding.op10_jump_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": op1_warc_index.SQL, "op5_exact_dedup": op5_exact_dedup.SQL}
