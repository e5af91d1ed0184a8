"""Catalogue of runnable queries: a Spark plan and, where SQL can say it, its ANSI twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    builder: Builder
    oracle: str | None

    def build(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.builder(spark, sf_dir)


QUERIES: dict[str, Query] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register ``fn(spark, sf_dir)`` under ``key`` with its optional SQL twin."""

    def register(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = Query(key, fn, oracle)
        return fn

    return register
