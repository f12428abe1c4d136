"""Registered queries of the trip engine and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
MODULES = ("scalar_queries", "relational_queries", "graph_queries", "planner_queries", "domain_queries", "feature_queries")


def register(name: str, sql: str | None = None):
    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"wayloom.plans.{m}")


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
