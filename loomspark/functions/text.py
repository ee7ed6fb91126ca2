"""Text expressions: code-aware tokens, windows, line places, names. Columns in, columns out; no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than one character: whole identifiers, their camelCase and acronym parts, and runs
    of letters and digits. Null text has none."""
    text = F.coalesce(text, F.lit(""))
    parts = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    runs = F.split(text, "[^A-Za-z0-9]+")
    named = F.transform(F.concat(runs, F.split(parts, "[^A-Za-z0-9]+")), lambda x: F.lower(F.regexp_replace(x, "^[0-9]+", "")))
    return F.array_distinct(F.filter(F.concat(named, F.transform(runs, F.lower)), lambda x: F.length(x) > 1))


def window_spans(text: Column, size: int = 900, overlap: int = 90) -> Column:
    """Array of structs (start, stop): overlapping windows that cover the text; none for an empty text, and no window that
    ends where the one before it ends."""
    step, n = size - overlap, F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("stop")))).otherwise(
        F.array().cast("array<struct<start:int,stop:int>>")
    )


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def encoded_ranges(lines: Column) -> Column:
    """Line numbers as text: 1,2,3,7 gives 1-3,7. Order and repeats don't matter; no lines give an empty text."""
    ordered = F.array_sort(F.array_distinct(lines))
    heads = F.filter(ordered, lambda x: ~F.array_contains(ordered, x - 1))
    tails = F.filter(ordered, lambda x: ~F.array_contains(ordered, x + 1))
    named = F.zip_with(heads, tails, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string"))))
    return F.array_join(named, ",")


def decoded_ranges(text: Column) -> Column:
    """Array of structs (lo, hi) of such a text; parts that aren't ranges are skipped, and so are lo < 1 and hi < lo."""
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    pairs = F.transform(parts, lambda x: F.struct(
        F.split_part(x, F.lit("-"), F.lit(1)).try_cast("int").alias("lo"),
        F.when(x.contains("-"), F.split_part(x, F.lit("-"), F.lit(2)).try_cast("int")).otherwise(x.try_cast("int")).alias("hi")))
    return F.filter(pairs, lambda r: r["lo"].isNotNull() & r["hi"].isNotNull() & (r["lo"] >= 1) & (r["hi"] >= r["lo"]))


def normal_repo(url: Column) -> Column:
    """A repository's address without blanks, closing slashes or .git."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, or an empty text."""
    return F.regexp_extract(basename(path), r"\.([^.]+)$", 1)


def fuzzy_score(query: str, text: Column) -> Column:
    """100 for the same text, 80 for a start, 60 for a part, 30 if its characters come in order, else null; case doesn't count."""
    q, hay = query.lower().strip(), F.lower(text)
    in_order = "(?s)" + ".*".join("\\Q" + c + "\\E" for c in q)
    return F.when(hay == q, 100).when(hay.startswith(q), 80).when(hay.contains(q), 60).when(hay.rlike(in_order), 30)
