"""Sinks: append, keyed rewrite, purge, capped logs. All go through Spark's commit protocol to a new folder or partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.logs import capped


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def purged(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is among gone; null keys stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def updated(rows: DataFrame, match: Column, values: dict[str, Column]) -> DataFrame:
    """rows with new values where match holds."""
    return rows.withColumns({c: F.when(match, v).otherwise(F.col(c)) for c, v in values.items()})


def compact(rows: DataFrame, path: str, by: str, newest: list[Column], keep: int) -> None:
    """The newest rows of each group, written over an older folder."""
    capped(rows, by, newest, keep).write.mode("overwrite").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Partitions that rows touch are replaced; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
