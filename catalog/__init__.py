"""Registered queries over the shared tables, each with its SQL where exact."""

from __future__ import annotations


def load():
    """(queries, sql) of every module in this package."""
    from catalog import modelling, relational, reports, scalars, tables  # noqa: F401
    from catalog.registry import QUERIES, SQL

    return QUERIES, SQL
