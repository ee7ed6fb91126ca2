"""Places of regular-expression matches in a text, with native functions alone.

What a lambda names from outside is worked out again at each step, and there a column's name may also mean an earlier alias of
the same select. So nothing but variables of lambdas is named inside them: arrays are zipped together or put into one struct first,
and ``let`` binds a value that is used more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a block in which pieces of a text are looked up.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being worked out once however often the body or a lambda in it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, with_: Callable[[Column, Column], Column]) -> Column:
    """Array of each value together with all before it, for an associative operation: doubling steps, n log n in all."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def doubled(a, step):
        return F.transform(a, lambda x, i: F.coalesce(with_(x, F.get(a, i - step)), x))

    return let(values, lambda v: F.aggregate(F.filter(steps, lambda s: s < F.size(v)), v, doubled))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of structs (start, end, value): leftmost matches that don't overlap, in code points, end exclusive;
    value is the given group of each. The pattern must not match the empty string. Null where nothing matches.

    split() gives what lies between the matches that regexp_extract_all() gives, so lengths add up to places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.zip_with(F.split(text, pattern, -1), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"), w.alias("value")))
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        sized = F.zip_with(sized, values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), v.alias("value")))
    # After the last match comes a gap without a match.
    matches = F.filter(sized, lambda x: x["size"].isNotNull())

    def placed(m):
        ends = running(F.transform(m, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return F.zip_with(m, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(matches, placed))


def pieces(text: Column, places: Column) -> Column:
    """Array of the pieces of the text at the places, structs (start, end) in code points: each costs its own length and
    a block or two, wherever in the text it lies."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(b: Column, x: Column) -> Column:
        first, last = (x["start"] / BLOCK).cast("int"), (x["end"] / BLOCK).cast("int")
        head = F.substring(F.get(b, first), x["start"] % BLOCK + 1, F.when(first == last, x["end"] - x["start"]).otherwise(F.lit(BLOCK)))
        middle = F.when(last > first + 1, F.array_join(F.slice(b, first + 2, last - first - 1), ""))
        tail = F.when(last > first, F.substring(F.get(b, last), F.lit(1), x["end"] % BLOCK))
        return F.concat_ws("", head, middle, tail)

    return let(F.struct(blocks.alias("blocks"), places.alias("places")), lambda v: F.transform(v["places"], lambda x: piece(v["blocks"], x)))
