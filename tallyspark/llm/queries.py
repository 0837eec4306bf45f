"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from tallyspark.llm import alignment, bpe, decontaminate, license_rules, line_dedup, ngram_join, preference_format, quality_model, quality_rules, sanitize, token_store, toxicity, variants

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_decontaminate": decontaminate.query,
    "op4_token_store": token_store.query,
    "op5_preference_format": preference_format.query,
    "op6_ngram_join": ngram_join.query,
    "op7_license_rules": license_rules.query,
    "op8_byte_pairs": bpe.query,
    "op9_toxicity": toxicity.query,
    "op10_quality_model": quality_model.query,
    "op11_token_alignment": alignment.query,
    "op12_spelling_variants": variants.query,
    "op13_sanitize": sanitize.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_preference_format": preference_format.ORACLE,
    "op7_license_rules": license_rules.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_sanitize": sanitize.ORACLE,
}
