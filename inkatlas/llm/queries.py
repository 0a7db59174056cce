"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from inkatlas.llm import queries_encoding, queries_groups, queries_overlaps, queries_splits, queries_texts, queries_vectors

_PARTS = (queries_groups, queries_vectors, queries_splits, queries_overlaps, queries_texts, queries_encoding)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
