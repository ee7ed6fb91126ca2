"""Files by folder, merged chunks, budgets over ordered parts, exports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.chat import fitting


def tree(files: DataFrame, path: str, language: str) -> DataFrame:
    """folder, depth, file_count, n_languages, top_language: every folder over the files, the root as an empty text."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    per = files.select(F.explode(ups).alias("folder"), F.col(language).alias("language")).groupBy("folder", "language").agg(F.count("*").alias("n"))
    out = per.groupBy("folder").agg(F.sum("n").alias("file_count"), F.count("*").alias("n_languages"), F.min_by("language", F.struct(-F.col("n"), "language")).alias("top_language"))
    return out.withColumn("depth", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))


def fitted(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """by, kept (orders, comma-joined), used: parts in order, the first always, then each that still fits; those that don't are
    left out and later ones may follow. A group is what one answer can cite."""
    rows = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).alias("s")))).alias("p"))
    keep = fitting(F.transform("p", lambda x: x["s"]), budget, 1)
    kept = F.filter("p", lambda x, i: F.get(keep, i))
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["s"])
    return rows.select(by, F.array_join(F.transform(kept, lambda x: x["o"].cast("string")), ",").alias("kept"), total.alias("used"))


def _merged(parts: list[str | None], least: int, most: int) -> str | None:
    """Pieces are gathered and joined once; only the last ``most`` characters so far are compared."""
    pieces, tail = [], ""
    for x in parts:
        if x is None:
            return None
        sizes = range(min(most, len(tail), len(x)), least - 1, -1)
        cut = next((n for n in sizes if tail.endswith(x[:n])), 0)
        new = x[cut:] if cut or not tail else "\n" + x
        pieces.append(new)
        tail = (tail + new[-most:])[-most:]
    return "".join(pieces)


def merged(parts: Column, least: int = 20, most: int = 200) -> Column:
    """One text of parts in order, without the longest overlap of 20 to 200 characters between neighbours."""

    def merge(rows: pa.Array) -> pa.Array:
        return pa.array([_merged(x.as_py(), least, most) if x.is_valid else None for x in rows], pa.string())

    return F.arrow_udf(merge, "string")(parts)


def markdown(rows: DataFrame, by: str, order: str, text: str, language: str) -> DataFrame:
    """by, bundle: the texts of a group in order, each in a fence."""
    block = F.concat(F.lit("```"), F.col(language), F.lit("\n"), F.col(text), F.lit("\n```"))
    got = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("x"))
    return got.select(by, F.concat(F.lit("# "), F.col(by).cast("string"), F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["b"]), "\n\n")).alias("bundle"))
