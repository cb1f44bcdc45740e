"""Queries over the driver's tables, one or more per operator, with SQL for the same rows."""

from __future__ import annotations

from . import events, records, retrieval, runs

_MODULES = (retrieval, events, runs, records)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
