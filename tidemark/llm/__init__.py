"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import exact, importance, lm, media, mixing, ngram_join, packing, phrases, quality, rules, suffix, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc_transactions": warc.op1_warc_transactions,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_suffix_dedup": suffix.op3_suffix_dedup,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_harmonic_packing": packing.op5_harmonic_packing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_source_mixing": mixing.op7_source_mixing,
        "op8_media_columns": media.op8_media_columns,
        "op9_lm_scoring": lm.op9_lm_scoring,
        "op10_quality_rules": rules.op10_quality_rules,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_exact_dedup": exact.op12_exact_dedup,
        "op13_phrase_collocations": phrases.op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_source_mixing": mixing.ORACLE_SQL,
        "op10_quality_rules": rules.ORACLE_SQL,
        "op11_importance_resampling": importance.ORACLE_SQL,
        "op12_exact_dedup": exact.ORACLE_SQL,
        "op13_phrase_collocations": phrases.ORACLE_SQL,
    }
