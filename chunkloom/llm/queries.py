"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from chunkloom.llm import exact_dedup, html_extraction, language_id, mixing, nearest, ngram_join, packing, pii, quality, substring_dedup

_MODULES = (language_id, packing, mixing, quality, nearest, ngram_join, pii, exact_dedup, substring_dedup, html_extraction)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
