"""Incremental indexing: what is new, changed, rebuilt, unchanged or gone; digests that don't depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(current: DataFrame, indexed: DataFrame, build: str) -> DataFrame:
    """source, action, n_stale: current (source, content_hash) against indexed rows (source, content_hash, index_build).

    A source whose rows disagree on the hash counts as changed; one whose rows were made by another build, or by none that is known, as
    rebuilt. Rows of changed, rebuilt and removed sources are stale.
    """
    known = indexed.groupBy("source").agg(
        F.count("*").alias("rows"), F.min(F.coalesce("content_hash", F.lit(""))).alias("h1"), F.max(F.coalesce("content_hash", F.lit(""))).alias("h2"),
        F.min(F.coalesce("index_build", F.lit(""))).alias("b1"), F.max(F.coalesce("index_build", F.lit(""))).alias("b2"),
    )
    both = current.withColumn("here", F.lit(True)).join(known, "source", "full")
    action = (
        F.when(F.col("here").isNull(), "removed")
        .when(F.col("rows").isNull(), "new")
        .when((F.col("h1") != F.col("content_hash")) | (F.col("h2") != F.col("content_hash")), "changed")
        .when((F.col("b1") != build) | (F.col("b2") != build), "rebuilt")
        .otherwise("skipped")
    )
    rows = both.select("source", action.alias("action"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return rows.select("source", "action", F.when(F.col("action").isin("new", "skipped"), 0).otherwise(F.col("rows")).cast("long").alias("n_stale"))


def removed(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """source of the indexed rows that no current file has."""
    return indexed.select("source").distinct().join(current, "source", "left_anti")


def digest(rows: DataFrame, by: str, text: str) -> DataFrame:
    """by, n, digest: sha256 over the texts of a group in any order.

    Texts' digests are joined in 4,096 parts by their first three signs, and the parts' digests in turn, so no task holds a
    group whole.
    """
    h = rows.select(by, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    parts = h.groupBy(by, F.left("h", F.lit(3)).alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return parts.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(whole, ""), 256).alias("digest"))
