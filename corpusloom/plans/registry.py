"""Queries by name, each with the SQL that it equals where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Registers a function of (t, spark, sf_dir), where ``t(name)`` reads a table."""

        def add(function: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return function(lambda name: table(spark, sf_dir, name), spark, sf_dir)

            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return function

        return add
