"""The queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from . import ann, decontaminate, divergence, language, line_dedup, lm, mixing, near_dup, negatives, pii, quality, token_counts, toxicity

QUERIES = {
    "op8_token_counts": token_counts.op8_token_counts,
    "op10_ann": ann.op10_ann,
    "op5_lm": lm.op5_lm,
    "op6_pii": pii.op6_pii,
    "op1_language": language.op1_language,
    "op3_quality": quality.op3_quality,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op2_near_dup": near_dup.op2_near_dup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op9_mixing": mixing.op9_mixing,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op2_near_dup": near_dup.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op13_divergence": divergence.ORACLE_SQL,
}
