"""The queries of this package and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, language, line_dedup, mixing, sharding, simhash, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sharding": sharding.op6_sharding,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_mixing": mixing.op9_mixing,
    "op10_language": language.op10_language,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
