"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from .plans import formula_queries, table_queries, vector_queries, workbook_queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "formula_queries", "table_queries", "vector_queries", "workbook_queries"]
