"""Named queries over the test tables."""

from __future__ import annotations


def load():
    """(queries, sql) of all modules of this package."""
    from palimpsest.plans import catalogue, papers, runs  # noqa: F401

    return dict(catalogue.QUERIES), dict(catalogue.SQL)
