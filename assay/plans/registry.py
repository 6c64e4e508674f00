"""Registered queries and their SQL counterparts.

Importing this module loads every query module; each registers its queries with ``query``. Doubles are
rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None) -> Callable:
    """Register the decorated function under its name, with the SQL that DuckDB checks it by."""

    def add(f: Callable) -> Callable:
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import calibrating, datasets, files, probability, rendering, serving, summaries, training  # noqa: E402, F401
