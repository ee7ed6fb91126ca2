"""Dependency graphs: degrees, hubs, layers, transitive dependents. Edges run from the importer (source) to the imported (target)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import checkpointed

#: Up to so many nodes have their hashes (some 40 bytes each) sent to all tasks, so that only edges into them are moved.
SENT = 1_000_000


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with degree: edges in and out; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))  # edges are worked out once for both
    return nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def hubs(nodes: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """The nodes of highest degree, ties by label and id."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "label", "id").limit(most)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among kept (id)."""
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


def _into(edges: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Edges among which are all those into the n nodes asked for (id); where they are few, no others but those of equal hash."""
    hashes = asked.select(F.xxhash64("id").alias("h")).distinct()
    return edges.join(F.broadcast(hashes), F.xxhash64("target") == F.col("h"), "left_semi") if n <= SENT else edges


def dependents(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """target, id, depth: what depends on each target (id), directly at depth 1 or through others; cycles end.

    Each round joins the newest nodes with the edges into them and drops those seen before. Rounds are as many as the longest
    shortest path; each is written to the checkpoint folder, so plans don't grow. Of the newest nodes only those with an edge into them
    are looked for, and edges that lead to none of them stay where they lie.
    """
    edges = checkpointed(edges.select("source", "target").distinct())
    ends = checkpointed(edges.select("target").distinct())
    frontier = targets.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    seen, found, depth = frontier, [], 0
    while max_depth is None or depth < max_depth:
        asked = checkpointed(frontier.join(ends, F.col("id") == F.col("target"), "left_semi").select("root", "id"))
        n = asked.count()
        if not n:
            break
        depth += 1
        step = _into(edges, asked, n).join(asked, F.col("id") == F.col("target")).select("root", F.col("source").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        found.append(frontier)
        seen = seen.unionByName(frontier)
    if not found:
        return frontier.where("false").select(F.col("root").alias("target"), "id", "depth")
    return reduce(DataFrame.unionByName, found).select(F.col("root").alias("target"), "id", "depth")


def level(score: Column, medium: int = 4, high: int = 7) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def blast_radius(edges: DataFrame, targets: DataFrame, sensitive: Column) -> DataFrame:
    """Per target (id): direct and impacted nodes, depth, score min(10, direct + impacted div 2 + depth - 1), plus 2 if
    sensitive (over the target's id), and its level."""
    reach = dependents(edges, targets).groupBy("target").agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("impacted"), F.max("depth").alias("depth")
    )
    rows = targets.select("id").distinct().join(reach, F.col("id") == F.col("target"), "left").fillna(0, ["direct", "impacted", "depth"])
    breadth = F.least(F.lit(10), F.col("direct") + F.floor(F.col("impacted") / 2) + F.greatest(F.col("depth") - 1, F.lit(0)))
    score = F.least(F.lit(10), breadth + F.when(sensitive, 2).otherwise(0)).cast("int")
    return rows.select("id", "direct", "impacted", "depth", score.alias("score")).withColumn("level", level(F.col("score")))


def within(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, depth of all nodes at most so many steps from the start (id), whichever way edges point."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    one = start.select("id").distinct()
    reached = dependents(both.select("source", "target"), one, depth).groupBy("id").agg(F.min("depth").alias("depth"))
    return one.withColumn("depth", F.lit(0)).unionByName(reached.join(one, "id", "left_anti"))


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """source, target: each import (source, stem) to the first file (id, stem) of that stem that isn't itself.

    That is one of the two least of the stem, so that a stem of very many files is one row of two for its imports. Tasks keep the two
    least of what they read before anything is moved.
    """
    order = F.dense_rank().over(Window.partitionBy("stem").orderBy("id"))
    two = files.where("stem is not null and id is not null").select("stem", "id", order.alias("nth")).where("nth <= 2")
    nth = lambda n: F.min(F.when(F.col("nth") == n, F.col("id")))
    each = imports.join(two.groupBy("stem").agg(nth(1).alias("first"), nth(2).alias("second")), "stem")
    target = F.when(F.col("source") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    return each.select("source", target.alias("target")).where("target is not null").distinct()
