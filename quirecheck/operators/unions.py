"""Unions that may be grouped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

#: More partitions than any child has, so nothing is merged.
MANY = 1 << 20


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name, without a promise of how they are partitioned.

    Spark 4.1 plans a union of equally partitioned children without a shuffle for a grouping above it.
    When adaptive execution then reuses one child's exchange, the union runs as a plain concatenation and
    a group appears once per child. A narrow coalesce takes that promise away, whatever the session says.
    """
    return reduce(DataFrame.unionByName, [f.coalesce(MANY) for f in frames])
