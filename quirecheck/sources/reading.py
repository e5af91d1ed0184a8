"""Helpers shared by all table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table that arrives in fewer splits than there are cores over all of them.

    A table with enough splits passes unchanged, so large inputs pay no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


#: Planned bytes of a table, as its files hold them, for one task that sorts or groups it.
TASK_BYTES = 8 << 20


def tasks(table: DataFrame) -> int | None:
    """Tasks that the planned size of ``table`` asks for; None if the session's number suffices."""
    planned = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-planned // TASK_BYTES)
    return n if n > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by keys to the ``tasks`` of the table they stem from, so a task that sorts or groups them holds no more of a larger table."""
    n = tasks(table)
    return df.repartition(n, *keys) if n else df.repartition(*keys)
