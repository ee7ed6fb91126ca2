"""History of files: blame and listings of trees, read from the text that git prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One line of a blame: commit, its number in the file, what is told of the commit (once for each), the line itself.
BLAMED = r"(?md)^([0-9a-f]{40}) \d+ (\d+)[^\n]*\n((?:[^\t\n][^\n]*\n)*+)\t([^\n]*)"
#: Parts in which the lines of one commit meet its details, as a commit may hold most lines of all files.
PARTS = 16


def _told(details: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(details, rf"(?md)^{key} ([^\n]*)", 1), F.lit(""))


def blamed(blames: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line_no, sha, short_sha, author, date, content: a row for each line of blames in git's porcelain form, a row a file.

    Git tells the author and time of a commit at its first line alone; all other lines of it, in whatever file, get them too, and
    an author that is told nowhere is empty, as is a date that isn't a number of seconds. Of unlike details the greatest hold.
    Null and empty texts have no lines. Files are cut where they lie; only lines are shuffled, by commit and part.
    """
    records = blames.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(BLAMED), F.lit(0))).alias("__record"))
    group = lambda k: F.regexp_extract("__record", BLAMED, k)
    lines = records.select(*keys, *[group(k + 1).alias(n) for k, n in enumerate(("sha", "no", "details", "content"))])
    told = lines.where(F.col("details") != "").select("sha", _told(F.col("details"), "author").alias("author"), _told(F.col("details"), "author-time").alias("time"))
    told = told.groupBy("sha").agg(F.max("author").alias("author"), F.max("time").alias("time"))
    told = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    lines = lines.withColumn("line_no", F.col("no").cast("long")).withColumn("__part", (F.col("line_no") % PARTS).cast("int"))
    seconds = F.expr("try_cast(time AS bigint)")
    days = F.when(F.abs(seconds) < 10**11, F.floor(seconds / 86_400).cast("int"))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")
    return lines.join(told, ["sha", "__part"], "left").select(
        *keys, "line_no", "sha", F.left("sha", F.lit(7)).alias("short_sha"), F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce(date, F.lit("")).alias("date"), "content",
    )


def listed(lines: DataFrame, line: str = "value") -> DataFrame:
    """mode, kind, object, size, path of the lines of a long recursive listing of a tree; what isn't such a line is left out.
    The size of what has none (a submodule) is null."""
    part = lambda k: F.regexp_extract(line, r"(?s)^(\d{6}) (\w+) ([0-9a-f]{40,64}) +(\d+|-)\t(.+)$", k)
    rows = lines.select(*[part(k + 1).alias(n) for k, n in enumerate(("mode", "kind", "object", "size", "path"))]).where("path <> ''")
    return rows.withColumn("size", F.expr("try_cast(size AS bigint)"))


def resolved(asked: DataFrame, tree: DataFrame, rel: str = "rel") -> DataFrame:
    """The rows of asked with resolved: the path of the tree that is meant by rel, or null.

    It is rel itself; else the shortest path that ends in it after a slash; else the shortest one of its base name; of equally
    long ones the first. Each path of the tree gives one row for each of its ends, those that share an end are counted down to
    one before anything meets, and ends meet what is asked by equality.
    """
    names = F.split("path", "/")
    paths = tree.select("path").distinct().select("path", names.alias("__names"), F.explode(F.sequence(F.lit(1), F.size(names))).alias("__k"))
    paths = paths.select("path", F.array_join(F.slice("__names", F.col("__k"), F.size("__names")), "/").alias("__end"))
    best = paths.groupBy("__end").agg(
        F.max((F.col("path") == F.col("__end")).cast("int")).alias("__itself"), F.min(F.struct(F.length("path").alias("n"), "path")).alias("__best")
    )
    best = best.select("__end", F.when(F.col("__itself") == 1, F.col("__end")).otherwise(F.col("__best.path")).alias("__path"))
    base = best.where(~F.col("__end").contains("/")).select(F.col("__end").alias("__base"), F.col("__path").alias("__by_base"))
    rows = asked.withColumn("__base_of", F.element_at(F.split(rel, "/"), -1))
    rows = rows.join(best, F.col(rel) == F.col("__end"), "left").join(base, F.col("__base_of") == F.col("__base"), "left")
    return rows.select(*asked.columns, F.coalesce("__path", "__by_base").alias("resolved"))
