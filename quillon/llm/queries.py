"""The registry of the corpus operators: queries by name, and SQL where SQL can express one."""

from __future__ import annotations

from . import decontaminate, jaccard, language, lines, mix, neighbours, pseudonyms, quality, separators, tokens

QUERIES = {
    "op1_mix": mix.op1_mix,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_tokens": tokens.op3_tokens,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_lines": lines.op7_lines,
    "op8_quality": quality.op8_quality,
    "op9_token_counts": separators.op9_token_counts,
    "op10_language": language.op10_language,
}
ORACLES = {
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op6_jaccard": jaccard.ORACLE_SQL,
}
