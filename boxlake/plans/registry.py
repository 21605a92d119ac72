"""Pairs every registered query with its DuckDB oracle, where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxlake.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Name -> Spark query, and name -> oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
        """Register a query; `needs` lists derived relations the SQL refers to by name."""

        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = with_relations(sql, needs)
            return fn

        return register


def with_relations(sql: str, needs: tuple[str, ...]) -> str:
    """`sql` with its derived relations as leading CTEs; `sql` may itself start with CTEs."""
    if not needs:
        return sql.strip()
    parts = []
    for name in needs:
        body = fixtures.images_sql() if name == "images" else fixtures.derived_sql(name)
        parts.append(f"{name} AS ({body})")
    text = sql.strip()
    recursive = "RECURSIVE " if text.upper().startswith("WITH RECURSIVE") else ""
    for lead in ("WITH RECURSIVE", "WITH"):
        if text.upper().startswith(lead):
            return f"WITH {recursive}{', '.join(parts)}, {text[len(lead):].lstrip()}"
    return f"WITH {', '.join(parts)} {text}"
