"""All queries of the library and their SQL counterparts."""

from __future__ import annotations

from .plans import calibration_queries, contract_queries, governance_queries, ledger_queries

MODULES = (ledger_queries, governance_queries, calibration_queries, contract_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
