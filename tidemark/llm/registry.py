"""Queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, fill_in_middle, html_extraction, importance_resampling, language_id, quality_classifier, quality_rules, simhash_dedup, source_mixing, substring_dedup, token_counts, warc_archive

_MODULES = (substring_dedup, decontaminate, warc_archive, simhash_dedup, chat_format, quality_rules, token_counts, source_mixing, language_id, quality_classifier, fill_in_middle, html_extraction, importance_resampling)


def queries() -> dict:
    return {"quality_rules_ablation": quality_rules.quality_rules_ablation} | {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict:
    return {"quality_rules_ablation": quality_rules.ABLATION} | {name: m.ORACLE for m in _MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit() and getattr(m, "ORACLE", None)}
