"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of ``t``, which gives a table by name."""

        def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            name = function.__name__
            self.queries[name] = lambda spark, sf_dir: function(lambda n: table(spark, sf_dir, n))
            if sql:
                self.oracle[name] = sql
            return function

        return add
