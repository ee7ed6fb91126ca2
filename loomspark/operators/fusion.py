"""Rank fusion, limits per group, and best row per parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_ranks(lists: list[DataFrame], by: str, key: str, k: int = 60) -> DataFrame:
    """by, key, score: the sum over all lists (by, key, rank) of 1 / (k + rank), 9 decimals; repeats in a list add up."""
    rows = reduce(DataFrame.unionByName, [x.select(by, key, (1 / (k + F.col("rank"))).alias("part")) for x in lists])
    return rows.groupBy(by, key).agg(F.round(F.sum("part"), 9).alias("score"))


def two_branches(first: DataFrame, second: DataFrame, by: str, key: str, k: int = 60) -> DataFrame:
    """by, key, score: each branch (by, key, score) is ranked by itself; half of 1 / (k + rank) from either, 9 decimals."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(key))
    a = first.select(by, key, F.row_number().over(w).alias("ra"))
    b = second.select(by, key, F.row_number().over(w).alias("rb"))
    half = lambda r: F.coalesce(0.5 / (k + F.col(r)), F.lit(0.0))
    return a.join(b, [by, key], "full").select(by, key, F.round(half("ra") + half("rb"), 9).alias("score"))


def diversified(rows: DataFrame, by: str, group: str, most: int = 2, top_n: int = 5) -> DataFrame:
    """The first top_n rows (by rank) of each ``by`` of which no group gives more than ``most``; rank is counted anew."""
    inside = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by, group).orderBy("rank"))).where(F.col("nth") <= most).drop("nth")
    again = inside.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank")).cast("int"))
    return again.where(F.col("rank") <= top_n)


def best_per_parent(rows: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """The row of least rank of each parent."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(rank))).where("nth = 1").drop("nth")
