"""Conversations: what of a history fits a budget, and what it costs. A conversation is bounded by what a person types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long")


def fitting(costs: Column, budget: int, always: int = 0) -> Column:
    """Array of booleans: of costs in order, the first ``always`` are kept, then each one that still fits; one that
    doesn't is left out and later, smaller ones may follow."""
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("keep"))

    def step(a, c):
        fits = (a["n"] < always) | (c <= a["left"])
        return F.struct((a["left"] - F.when(fits, c).otherwise(0)).cast("long").alias("left"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), F.array_append(a["keep"], fits).alias("keep"))

    return F.aggregate(costs, zero, step, lambda a: a["keep"])


def pruned(messages: DataFrame, budget: int = 2000, keep_last: int = 2) -> DataFrame:
    """Per conversation: messages and tokens before and after dropping old ones over the budget, newest first."""
    rows = messages.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", tokens(F.col("text")).alias("cost"))))).alias("m"))
    rows = rows.select("conv_id", F.transform("m", lambda x: x["cost"]).alias("costs"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.select("*", total(F.col("costs")).alias("tokens_before"), F.size("costs").cast("long").alias("n_before"))
    keep = F.when((F.col("tokens_before") <= budget) | (F.col("n_before") <= keep_last), F.transform("costs", lambda c: F.lit(True))).otherwise(fitting(F.col("costs"), budget, keep_last))
    left = F.filter("costs", lambda c, i: F.get(F.col("keep"), i))
    return rows.select("*", keep.alias("keep")).select("conv_id", "n_before", F.size(left).cast("long").alias("n_kept"), "tokens_before", total(left).alias("tokens_after"))


def compacted(messages: DataFrame, last: int = 6, most: int = 250) -> DataFrame:
    """Per conversation its last turns, one a line, each cut to ``most`` characters."""
    rows = messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= last)
    said = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.upper(F.left("role", F.lit(1))), F.expr("substring(role, 2)"), F.lit(": "), said)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def cost(messages: DataFrame, prompt: float = 1.5e-7, completion: float = 6e-7) -> DataFrame:
    """Per conversation prompt and completion tokens and their price, 6 decimals."""
    answer = F.col("role") == "assistant"
    n = tokens(F.col("text"))
    rows = messages.groupBy("conv_id").agg(F.sum(F.when(~answer, n).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(answer, n).otherwise(0)).alias("completion_tokens"))
    return rows.withColumn("cost", F.round(F.col("prompt_tokens") * prompt + F.col("completion_tokens") * completion, 6))
