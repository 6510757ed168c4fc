"""Registration of queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A query, the operators it exercises, and the same result as SQL where SQL can say it."""

    run: Callable[[SparkSession, str], DataFrame]
    operators: str
    sql: str | None = None


class Registry(dict):
    def add(self, name: str, operators: str, sql: str | None = None):
        def keep(fn):
            self[name] = Query(fn, operators, sql)
            return fn
        return keep
