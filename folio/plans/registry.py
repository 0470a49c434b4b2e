"""Registered queries: a Spark plan, its output shape and, where SQL can say it, check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .export import shaped, shaped_sql
from .ledger import Ledger
from .views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    shape: str
    build: Callable[[Ledger], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shaped(self.build(Ledger(spark, sf_dir)), self.shape)

    def check_sql(self) -> str | None:
        return None if self.sql is None else shaped_sql(with_views(self.sql), self.shape)


QUERIES: dict[str, Query] = {}


def query(name: str, shape: str, sql: str | None = None):
    def add(build):
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, shape, build, sql)
        return build

    return add
