"""All queries over the invoice engine's operators and their SQL."""

from __future__ import annotations

from ledgerlens.plans import batch_queries, extract_queries, rule_queries, text_queries, trap_queries

MODULES = (rule_queries, text_queries, extract_queries, batch_queries, trap_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
