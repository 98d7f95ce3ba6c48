"""The registered queries over the test tables, and their SQL counterparts."""

from __future__ import annotations


def _load() -> None:
    from registry import product_queries, result_queries, source_queries, text_queries  # noqa: F401


def all_queries():
    _load()
    from registry.core import QUERIES

    return dict(QUERIES)


def all_sql():
    _load()
    from registry.core import SQL

    return dict(SQL)
