"""Rows of large tables by few keys: keys of a measured size go to all tasks, so that the table stays where it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that take up to so many bytes, roughly as text, are sent to all tasks; more are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame) -> bool:
    """Whether the rows are few enough to be sent to all tasks."""
    size = df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*"))) + 16), F.lit(0))).first()[0]  # one number
    return size <= BROADCAST_BYTES


def told(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks of a join if it is small; it is run once more for that, so it should be cut off its lineage."""
    return F.broadcast(df) if small(df) else df


def named(table: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of the table whose key ``few`` has: what is worked out of them afterwards isn't worked out of all others."""
    return table.join(told(few.select(key).distinct()), key, "left_semi")
