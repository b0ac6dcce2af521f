"""Where the modules of queries keep them."""

from __future__ import annotations


def registry():
    """Empty QUERIES and ORACLES, and the decorator that adds a query under its name, with the SQL that states it."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
