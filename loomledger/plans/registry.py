"""The registry: each query by key, with its DuckDB twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.bindings import SQL_VIEWS

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Registers a function (spark, sf_dir) -> DataFrame under its name; `sql` sees the domain views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if not views:
                ORACLE[f.__name__] = text
            elif text.upper().startswith("WITH "):
                ORACLE[f.__name__] = f"WITH {SQL_VIEWS},\n{text[5:]}"
            else:
                ORACLE[f.__name__] = f"WITH {SQL_VIEWS}\n{text}"
        return f

    return add
