"""All registered queries and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame callable with the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _load() -> None:
    from evidara.plans import (  # noqa: F401  importing registers
        checks,
        evaluation,
        formats,
        relational,
        splitting,
        streams,
        texts,
    )


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict:
    _load()
    return SQL
