"""Retrieval measured by spans: sets of intervals by a sweep, the rank of the unit that holds the answer, recall of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.lookup import small

#: Length of the stretches in which intervals are swept.
STRETCH = 65_536


def covered(spans: DataFrame, by: list[str], stretch: int = STRETCH) -> DataFrame:
    """by, found_length, true_length, both_length: the lengths that two sets of intervals cover, and cover together, in each group.

    spans: by, side ('found' or 'true'), start, stop (exclusive); intervals may overlap and repeat, empty ones count for nothing. They are cut
    at multiples of ``stretch``, so that a file of very many intervals is swept in many tasks, and changes at one place are added up
    before the sweep.
    """
    first, last = F.floor(F.col("start") / stretch), F.floor((F.col("stop") - 1) / stretch)
    cut = spans.where("stop > start").select(*by, "side", "start", "stop", F.explode(F.sequence(first, last)).alias("part"))
    low, high = F.greatest(F.col("start"), F.col("part") * stretch), F.least(F.col("stop"), (F.col("part") + 1) * stretch)
    ends = cut.select(*by, "part", "side", F.explode(F.array(F.struct(low.alias("at"), F.lit(1).alias("d")), F.struct(high.alias("at"), F.lit(-1).alias("d")))).alias("x"))
    change = lambda side: F.sum(F.when(F.col("side") == side, F.col("x.d")).otherwise(0)).alias(side)
    places = ends.groupBy(*by, "part", F.col("x.at").alias("at")).agg(change("found"), change("true"))
    order = Window.partitionBy(*by, "part").orderBy("at")
    within = lambda side: F.sum(side).over(order) > 0
    swept = places.select(*by, within("found").alias("f"), within("true").alias("t"), (F.lead("at").over(order) - F.col("at")).alias("length"))
    total = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("length"))), F.lit(0)).cast("long").alias(name)
    f, t = F.col("f"), F.col("t")
    return swept.groupBy(*by).agg(total(f, "found_length"), total(t, "true_length"), total(f & t, "both_length"))


def overlap(found: DataFrame, true: DataFrame, legs: list[str], stretch: int = STRETCH) -> DataFrame:
    """leg, found_length, true_length, both_length, span_recall, span_precision (percent) over all queries.

    found: leg, q, file, start, stop. true: q, file, start, stop. A leg that finds nothing has a row too; a share of nothing is null.
    """
    every = true.select(F.explode(F.array(*[F.lit(x) for x in legs])).alias("leg"), "q", "file", F.lit("true").alias("side"), "start", "stop")
    rows = found.select("leg", "q", "file", F.lit("found").alias("side"), "start", "stop").unionByName(every)
    per = covered(rows, ["leg", "q", "file"], stretch).groupBy("leg").agg(*[F.sum(c).alias(c) for c in ("found_length", "true_length", "both_length")])
    spark = found.sparkSession
    whole = spark.createDataFrame([(x,) for x in legs], "leg string").join(per, "leg", "left").fillna(0)
    share = lambda of: F.round(100 * F.col("both_length") / F.nullif(F.col(of), F.lit(0)), 4)
    return whole.withColumns({"span_recall": share("true_length"), "span_precision": share("found_length")})


def localized(asked: DataFrame, units: DataFrame, k: int = 5) -> DataFrame:
    """leg, n_queries, span_scored, span_hit_at_k, span_mrr, span_precision_at_k, symbol_recall: how often one of the first k units IS the answer.

    asked: q, symbols (array of strings that the answer names). units: leg, q, rank, right (the unit is of a file that answers), text, parent (the
    text that the unit stands for). A unit is the answer if it is of such a file and its own text has one of the symbols; a symbol is recalled if a parent
    has it. Queries without symbols aren't scored: where there are none, hit, rank and precision are null, not 0; a scored query that retrieves nothing
    counts as a miss, and has no precision.
    """
    has = lambda text: lambda s: F.contains(text, s)
    some = asked.select("q", F.filter(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: s != "").alias("symbols"))
    legs = units.select("leg").distinct()
    # Symbols are few; the texts of units stay where they are until they have been searched.
    held = units.where(F.col("rank") <= k).join(F.broadcast(some) if small(some) else some, "q")
    looked = held.select("leg", "q", "rank", (F.col("right") & F.exists("symbols", has(F.col("text")))).alias("is"), F.filter("symbols", has(F.col("parent"))).alias("seen"))
    first = F.min(F.when(F.col("is"), F.col("rank")))
    per = looked.groupBy("leg", "q").agg(first.alias("first"), F.count_if("is").alias("n_right"), F.count("*").alias("n_units"))
    recalled = looked.select("leg", "q", F.explode("seen").alias("s")).distinct().groupBy("leg", "q").agg(F.count("*").alias("n_seen"))
    n = some.select("q", F.size(F.array_distinct("symbols")).alias("n_symbols"))
    rows = legs.join(F.broadcast(n), how="cross") if small(n) else legs.join(n, how="cross")  # as many rows as legs times queries: what is reported on
    rows = rows.join(per, ["leg", "q"], "left").join(recalled, ["leg", "q"], "left")
    scored: Column = F.col("n_symbols") > 0
    mean = lambda value: F.avg(F.when(scored, value))
    return rows.groupBy("leg").agg(
        F.count("*").alias("n_queries"),
        F.count_if(scored).alias("span_scored"),
        F.round(100 * mean(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 4).alias("span_hit_at_k"),
        F.round(mean(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("span_mrr"),
        F.round(100 * mean(F.col("n_right") / F.col("n_units")), 4).alias("span_precision_at_k"),
        F.round(100 * F.sum(F.when(scored, F.coalesce("n_seen", F.lit(0)))) / F.nullif(F.sum("n_symbols"), F.lit(0)), 4).alias("symbol_recall"),
    )
