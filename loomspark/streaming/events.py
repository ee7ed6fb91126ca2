"""Streams of events. Each function takes a streaming (or batch) DataFrame of event_id, ts, user_id, event_type, value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, new ones as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type; events later than the watermark allows are left out."""
    w = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = w.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events without a longer gap."""
    w = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = w.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "n")


def told_once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first event of each (user, type) within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def rolling(events: DataFrame, before: int = 20) -> DataFrame:
    """event_id, user_id, rolling: mean of each event and up to ``before`` ahead of it of the same user, in the order of ids
    within a batch; the state of a user is that many values."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("event_id")
        means = []
        for v in rows["value"]:
            kept = [*kept, v][-(before + 1) :]
            means.append(sum(kept) / len(kept))
        state.update((kept,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "rolling": means})

    rows = events.select("event_id", "user_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(update, "event_id long, user_id long, rolling double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def run_states(events: DataFrame) -> DataFrame:
    """Per user, updated as steps come: counts of each type, and failed before running before done."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    rows = events.groupBy("user_id").agg(n("error").alias("failed"), n("click").alias("running"), n("purchase").alias("done"))
    return rows.withColumn("state", F.when(F.col("failed") > 0, "failed").when(F.col("running") > 0, "running").when(F.col("done") > 0, "done").otherwise("skipped"))
