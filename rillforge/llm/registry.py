"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, brown_lm, language, licences, media, mixing, ngram_join, quality_classifier, quality_rules, toxicity

_MODULES = (licences, quality_rules, language, toxicity, ngram_join, mixing, bpe, brown_lm, media, quality_classifier)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
