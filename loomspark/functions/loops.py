"""Loops within loops and bare excepts of indented code: a stack of open loops carried along the lines as a fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.arrays import let

#: Fixed patterns: the head of a loop, and an except that catches everything.
LOOP = r"^(?:for|while)\b"
BARE = r"^except:$|^except\s+Exception\s*(?:\s+as\s+\w+)?\s*:"


def nesting(text: Column) -> Column:
    """Struct (nested_loops, bare_excepts, deepest): loops that stand in a loop, excepts without a kind of their own, and most loops open at once.

    A line that isn't blank closes the loops that are indented as far as it or further. The stack holds ever deeper indents, so that a step costs
    no more than the depth; null text has none of each.
    """

    def step(s: Column, line: Column) -> Column:
        def seen(v: Column) -> Column:
            open_ = F.filter(s["stack"], lambda x: x < v["indent"])
            is_loop = v["body"].rlike(LOOP)
            stack = F.when(is_loop, F.concat(open_, F.array(v["indent"]))).otherwise(open_)
            return F.struct(
                stack.alias("stack"),
                (s["nested"] + F.when(is_loop & (F.size(open_) > 0), 1).otherwise(0)).alias("nested"),
                (s["bare"] + F.when(v["body"].rlike(BARE), 1).otherwise(0)).alias("bare"),
                F.greatest(s["deepest"], F.size(stack)).alias("deepest"),
            )

        body = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        indent = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        return let(F.struct(body.alias("body"), indent.cast("int").alias("indent")), seen)

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(r"^\s*$"))
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("nested"), F.lit(0).alias("bare"), F.lit(0).alias("deepest"))
    return F.aggregate(lines, start, step, lambda s: F.struct(s["nested"].alias("nested_loops"), s["bare"].alias("bare_excepts"), s["deepest"].alias("deepest")))
