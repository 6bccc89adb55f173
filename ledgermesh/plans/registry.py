"""Registry of queries: name -> function of (session, folder), and the SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self._sql: dict[str, str | Callable[[], str]] = {}

    @property
    def sql(self) -> dict[str, str]:
        return {k: s() if callable(s) else s for k, s in self._sql.items()}

    def query(self, name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
        """Register a query; without sql it is tested against brute force instead. SQL may be given by a function, called late."""

        def add(f: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self._sql[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
