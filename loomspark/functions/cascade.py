"""Chunks of a text by a cascade of separators, with exact places and lines, as one native expression.

A text is split at the first separator that it has; a part that is still too long is split at the next one it has, and so on, down to
characters. Each separator stays at the head of its part. Neighbouring parts of one split are then put together again, as many as
a chunk takes; the next chunk begins with as many of the last parts as the overlap takes. White space at the ends of a chunk goes.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.arrays import let, let_all, running_sum

SEPARATORS = ("\n\n", "\n", " ")
#: Separators by language, widest first; after them come the general ones.
BY_LANGUAGE = {
    "py": ("\nclass ", "\ndef ", "\n\tdef "),
    "js": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault "),
    "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase "),
    "md": ("\n# ", "\n## ", "\n### "),
}
#: White space that is stripped, as a class of Java's patterns.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def _split(parts: Column, separator: str, level: int, size: int) -> Column:
    """Parts that are open and have the separator are replaced by what it splits them into."""

    def pieces(p: Column) -> Column:
        gaps = F.transform(F.split(p["t"], F.lit(rf"\Q{separator}\E"), -1), lambda g, i: F.concat(F.when(i > 0, F.lit(separator)).otherwise(F.lit("")), g))
        named = lambda t: F.struct(t.alias("t"), (F.length(t) >= size).alias("open"), F.concat(p["of"], F.lit(f"{level}:"), p["nth"].cast("string"), F.lit("/")).alias("of"))
        made = F.transform(F.filter(gaps, lambda t: t != ""), named)
        return F.transform(made, lambda x, i: F.struct(x["t"].alias("t"), x["open"].alias("open"), x["of"].alias("of"), i.cast("int").alias("nth")))

    def one(p: Column) -> Column:
        return F.when(p["open"] & F.contains(p["t"], F.lit(separator)), pieces(p)).otherwise(F.array(p))

    return F.flatten(F.transform(parts, one))


def _leaves(text: Column, size: int, overlap: int, separators: tuple[str, ...]) -> Column:
    """Array of structs (t, of): the parts that are put together, and the split that each comes from."""
    start = F.struct(text.alias("t"), F.lit(True).alias("open"), F.lit("").alias("of"), F.lit(0).alias("nth"))
    parts = F.array(start)
    for level, separator in enumerate(separators):
        parts = _split(parts, separator, level, size)
    # What no separator splits goes by characters, so many at a time as chunk and overlap have in common.
    unit = gcd(size, overlap) or size

    def cut(p: Column) -> Column:
        each = F.transform(F.regexp_extract_all(p["t"], F.lit(rf"(?s).{{1,{unit}}}"), F.lit(0)), lambda t: F.struct(t.alias("t"), F.concat(p["of"], F.lit("c:"), p["nth"].cast("string")).alias("of")))
        return F.when(p["open"], each).otherwise(F.array(F.struct(p["t"].alias("t"), p["of"].alias("of"))))

    return F.flatten(F.transform(parts, cut))


def chunks(text: Column, size: int = 700, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of structs (start, stop, start_line, end_line, text): chunks of at most ``size`` characters and where they stand, in code points
    (stop exclusive) and in lines from 1. Null and blank texts have none. Time grows with the length of the text, times its logarithm."""

    def folded(v: Column) -> Column:
        """Pairs (from, to) of leaves: the fold knows where the chunk that grows began."""

        def step(s: Column, i: Column) -> Column:
            other = (i > 0) & (F.get(v["leaves"], i)["of"] != F.get(v["leaves"], i - 1)["of"])
            end = F.get(v["ends"], i)
            before = lambda j: F.when(j > 0, F.get(v["ends"], j - 1)).otherwise(F.lit(0))
            over = end - before(s["head"]) > size
            fits = lambda j: (j == i) | ((before(i) - before(j) <= overlap) & (end - before(j) <= size))
            head = F.when(other, i).when(over, F.get(F.filter(F.sequence(s["head"], i), fits), F.lit(0))).otherwise(s["head"])
            out = F.when(other | over, F.concat(s["out"], F.array(F.struct(s["head"].alias("a"), i.alias("b"))))).otherwise(s["out"])
            return F.struct(head.alias("head"), out.alias("out"))

        none = F.array().cast("array<struct<a:int,b:int>>")
        start = F.struct(F.lit(0).alias("head"), none.alias("out"))
        n = F.size(v["leaves"])
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        last = lambda s: F.when(n > 0, F.concat(s["out"], F.array(F.struct(s["head"].alias("a"), n.alias("b"))))).otherwise(none)
        return F.aggregate(places, start, step, last)

    def placed(v: Column) -> Column:
        def one(x: Column) -> Column:
            raw = F.array_join(F.transform(F.slice(v["leaves"], x["a"] + 1, x["b"] - x["a"]), lambda p: p["t"]), "")
            at = F.when(x["a"] > 0, F.get(v["ends"], x["a"] - 1)).otherwise(F.lit(0))
            line = F.when(x["a"] > 0, F.get(v["lines"], x["a"] - 1)).otherwise(F.lit(0))

            def told(r: Column) -> Column:
                left = F.regexp_replace(r["raw"], rf"^{_BLANK}+", "")
                whole = F.regexp_replace(left, rf"{_BLANK}++$", "")
                start = r["at"] + F.length(r["raw"]) - F.length(left)
                skipped = F.left(r["raw"], F.length(r["raw"]) - F.length(left))
                first = r["line"] + _breaks(skipped) + 1
                return let(
                    F.struct(whole.alias("t"), start.alias("s"), first.alias("l")),
                    lambda k: F.struct(k["s"].alias("start"), (k["s"] + F.length(k["t"])).alias("stop"), k["l"].alias("start_line"), (k["l"] + _breaks(k["t"])).alias("end_line"), k["t"].alias("text")),
                )

            return let_all({"raw": raw, "at": at, "line": line}, told)

        return F.filter(F.transform(v["pairs"], one), lambda c: c["stop"] > c["start"])

    def summed(leaves: Column) -> Column:
        ends = running_sum(F.transform(leaves, lambda p: F.length(p["t"])))
        lines = running_sum(F.transform(leaves, lambda p: _breaks(p["t"])))
        with_pairs = lambda v: let_all({"leaves": v["leaves"], "ends": v["ends"], "lines": v["lines"], "pairs": folded(v)}, placed)
        return let_all({"leaves": leaves, "ends": ends, "lines": lines}, with_pairs)

    return let(_leaves(F.coalesce(text, F.lit("")), size, overlap, separators), summed)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
