"""Registration of queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.found: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.found[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return register

    def queries(self) -> dict[str, Query]:
        return dict(self.found)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
