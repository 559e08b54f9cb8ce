"""Every operator as a query over the test tables, with equivalent SQL for an independent engine."""

from __future__ import annotations

from catalogue import (
    check_queries,
    column_queries,
    function_queries,
    predicate_queries,
    profile_queries,
    relational_queries,
    scan_queries,
)
from catalogue.registry import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "check_queries",
    "column_queries",
    "function_queries",
    "predicate_queries",
    "profile_queries",
    "relational_queries",
    "scan_queries",
]
