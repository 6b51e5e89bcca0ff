"""All queries of the library by name, and the SQL that DuckDB is held against."""

from __future__ import annotations

from . import html_queries, lexical_queries, record_queries, request_queries, table_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (text_queries, vector_queries, lexical_queries, record_queries, html_queries, request_queries, table_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
