"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from twinlathe.llm import (
    bpe, conversation_repair, embedding_dedup, jaccard_join, language_id, license_scan, mixing, ordinal_quality, quality_rules, ranked_search, secret_scan, token_files, warc,
)

_MODULES = (
    mixing, language_id, jaccard_join, embedding_dedup, bpe, warc, license_scan, token_files, ordinal_quality, quality_rules, ranked_search, conversation_repair, secret_scan,
)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
