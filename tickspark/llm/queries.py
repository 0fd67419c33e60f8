"""The registered query of each corpus operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from tickspark.llm import decontaminate, exact_dedup, language, line_dedup, lm_score, ngram_join, packing, quality, ranked_search, secret_scan, source_audit, suffix_dedup, toxicity

QUERIES = {
    "op1_language": language.op1_language,
    "op2_quality": quality.op2_quality,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLES = {**exact_dedup.ORACLE, **decontaminate.ORACLE, **lm_score.ORACLE, **source_audit.ORACLE, **ranked_search.ORACLE}
