"""Request logs and feeds: summaries, ranks, rolling means, capped logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import checkpointed


def running_sums(rows: DataFrame, by: str, order: list[Column], values: list[str]) -> DataFrame:
    """rows with upto_<value> for each value: its sum over the row and all rows of its group before it (equal places in the
    order are before each other).

    Rows are cut into ranges of the order; sums of whole ranges are added up first, then those inside each. So a group that
    holds most rows is the work of many tasks.
    """
    placed = checkpointed(rows.repartitionByRange(F.col(by), *order).withColumn("__range", F.spark_partition_id()))
    totals = placed.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__of")).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__by", "__of", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(by, "__range").orderBy(*order)
    joined = placed.join(totals, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    return joined.select(*rows.columns, *[(F.sum(v).over(inside) + F.col(f"__{v}")).alias(f"upto_{v}") for v in values])


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, n and, for each name, the value at a 1-based rank (an expression over n) in ascending order.

    Equal values are counted first; running counts are summed up range by range.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    running = running_sums(counts, by, [F.col(value)], ["n"]).withColumnRenamed("n", "own")
    total = counts.groupBy(F.col(by).alias("__by")).agg(F.sum("n").alias("n"))
    joined = running.join(total, F.col(by).eqNullSafe(F.col("__by")))
    picked = [F.min(F.when(F.col("upto_n") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    return joined.groupBy(by).agg(F.max("n").alias("n"), *picked)


def endpoint_summary(rows: DataFrame, by: str, value: str, failed: Column, top: int = 30) -> DataFrame:
    """Per endpoint: count, errors, avg (2 decimals), p95 (0-based place min(n - 1, int(0.95 n))) and max; the busiest first."""
    p95 = at_ranks(rows, by, value, {"p95": F.least(F.col("n"), F.floor(F.col("n") * 0.95) + 1)}).drop("n")
    total = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(failed, 1).otherwise(0)).alias("errors"), F.round(F.avg(value), 2).alias("avg_value"), F.max(value).alias("max_value"))
    return total.join(p95, by).orderBy(F.desc("n"), by).limit(top)


def nearest_rank(rows: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Per group the values at the 1-based places ceil(p n / 100)."""
    return at_ranks(rows, by, value, {f"p{p}": F.ceil(F.col("n") * p / 100) for p in percents})


def rolling_mean(rows: DataFrame, by: str, order: str, value: str, before: int = 20, digits: int = 2) -> DataFrame:
    """rows with the mean of each one and up to ``before`` rows ahead of it in its group."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-before, 0)
    return rows.withColumn("rolling", F.round(F.avg(value).over(w), digits))


def capped(rows: DataFrame, by: str, newest: list[Column], keep: int) -> DataFrame:
    """The newest ``keep`` rows of each group."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).where(F.col("nth") <= keep).drop("nth")


def evicted(rows: DataFrame, by: str, newest: list[Column], size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """rows with kept: whether a row and all newer ones of its group stay within both caps."""
    upto = running_sums(rows.withColumn("__one", F.lit(1)), by, newest, ["__one", size])
    kept = (F.col("upto___one") <= most_rows) & (F.col(f"upto_{size}") <= most_bytes)
    return upto.select(*rows.columns, kept.alias("kept"))
