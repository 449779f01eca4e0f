"""Shared pieces of the query modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline import views

# Fixed end of all look-backs, so that results do not depend on the clock.
AS_OF = "2024-01-31 00:00:00"


class Registry(dict):
    """name -> (function, DuckDB text); `@registry.add(name, sql)` registers a function."""

    def add(self, name: str, sql: str | None = None):
        def keep(function):
            self[name] = (function, sql)
            return function

        return keep


def r6(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6)


def day(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("date").cast("string")


def with_views(*names: str, ctes: str = "", body: str = "", recursive: bool = False) -> str:
    """DuckDB text: the sample views, further CTEs and the final select."""
    head = "with recursive " if recursive else "with "
    return head + views.duckdb_cte(*names) + (",\n" + ctes if ctes else "") + "\n" + body
