"""Secret scans: key shapes and assignments, and strings whose sliding windows have a high Shannon entropy."""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.spans import found, let, pieces, running

#: Fixed patterns of the base kinds. A greedy run that is too short holds no longer one, so the last two ask for the
#: length at once; an assignment that is too short still takes its place, so its length is asked for afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings for the entropy test, and the window slid over them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Windows that are looked at together, before it is asked whether one has reached the limit.
STRETCH = 200
#: Bits a character that the best window must reach, by the characters that the candidate is made of.
LIMITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8, "letters": 4.1}
#: Known strings that are no secrets: UUIDs, numbers with dashes, documented example keys, runs of one mark, words joined by marks.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9=+/_-]+$",
    r"EXAMPLE|(?i)x{6,}|0123456789|abcdefghij",
    r"^[+/_=-]*[A-Za-z]*(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4})){2,}+[+/_=-]*$",
)


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def best_entropy(chars: Column, window: int = WINDOW) -> Column:
    """Highest entropy (bits a character) of any window of the array of characters; -1 if it is shorter than that.

    The counts of a window's characters and the sum of n log n over them are carried along: the character that comes in
    and the one that goes out change one count each. A step costs as much as a window has different characters.
    """

    def counted(counts: Column, c: Column, n: Column) -> Column:
        rest = F.map_filter(counts, lambda k, _: k != c)
        return F.when(n > 0, F.map_concat(rest, F.create_map(c, n))).otherwise(rest)

    def more(a, x):
        comes, goes = x["comes"], x["goes"]
        n_in = F.coalesce(F.try_element_at(a["counts"], comes), F.lit(0))

        def left(counts):
            n_out = F.coalesce(F.try_element_at(counts, goes), F.lit(0))
            total = a["sum"] + _weight(n_in + 1) - _weight(n_in) - F.when(goes.isNull(), F.lit(0.0)).otherwise(_weight(n_out) - _weight(n_out - 1))
            entropy = F.when(x["full"], F.lit(log2(window)) - total / window).otherwise(F.lit(-1.0))
            kept = F.when(goes.isNull(), counts).otherwise(counted(counts, goes, n_out - 1))
            return F.struct(total.alias("sum"), F.greatest(a["best"], entropy).alias("best"), kept.alias("counts"))

        return let(counted(a["counts"], comes, n_in + 1), left)

    steps = let(chars, lambda v: F.transform(v, lambda c, i: F.struct(c.alias("comes"), F.get(v, i - window).alias("goes"), (i >= window - 1).alias("full"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"), F.create_map().cast("map<string,int>").alias("counts"))
    return F.aggregate(steps, start, more, lambda a: a["best"])


def _limit(value: Column) -> Column:
    """The limit of a candidate's class; none for digits alone."""
    digit, letter = value.rlike("[0-9]"), value.rlike("[A-Za-z]")
    return (
        F.when(~letter, F.lit(None).cast("double"))
        .when(~digit, F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), LIMITS["letters"]))
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), LIMITS["hex"])
        .when(value.rlike("^[A-Za-z0-9]+$"), LIMITS["alnum"])
        .otherwise(LIMITS["base64"])
    )


def _entropy_spans(text: Column) -> Column:
    allowed = lambda v: reduce(Column.__or__, [v.rlike(p) for p in ALLOWED])
    judged = F.transform(found(text, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _limit(x["value"]).alias("limit")))
    likely = F.filter(judged, lambda x: x["limit"].isNotNull() & ~allowed(x["value"]))
    # Stretches of a candidate overlap so that each window lies in one; the first that reaches the limit ends the search.
    starts = lambda v: F.sequence(F.lit(0), F.length(v) - WINDOW, F.lit(STRETCH))
    places = lambda v: F.transform(starts(v), lambda s: F.struct(s.alias("start"), F.least(s + (STRETCH + WINDOW - 1), F.length(v)).alias("end")))

    def secret(x):
        stretches = let(x["value"], lambda v: pieces(v, places(v)))
        return F.exists(stretches, lambda p: best_entropy(F.regexp_extract_all(p, F.lit("."), F.lit(0))) >= x["limit"])

    return F.filter(likely, secret)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.coalesce(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))), _none())


def _uncovered(spans: Column) -> Column:
    """Sorted spans without those of entropy that lie within one of a base kind, which starts no later and comes first."""
    entropy = KINDS.index("entropy")

    def kept(all_):
        reach = running(F.transform(all_, lambda x: F.when(x["kind"] == entropy, F.lit(-1)).otherwise(x["end"])), F.greatest)
        marked = F.zip_with(all_, reach, lambda x, r: F.struct(x.alias("x"), ((x["kind"] == entropy) & (r >= x["end"])).alias("within")))
        return F.transform(F.filter(marked, lambda m: ~m["within"]), lambda m: m["x"])

    return let(spans, kept)


def scanned(docs: DataFrame, base: str = "base_found", every: str = "all_found") -> DataFrame:
    """docs with two arrays of structs (start, kind, end) added, row for row: base spans and all spans, by start and kind.

    kind is the place in KINDS; places are code points, end exclusive. Entropy adds the candidates that don't lie within
    a base span. A null text is an empty one. Columns of the two names in docs are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [c for c in docs.columns if c not in (base, every)]
    assign = F.filter(found(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    parts = docs.select(
        *rest,
        F.sort_array(F.concat(_of_kind(assign, 0), _of_kind(found(text, ACCESS), 1), _of_kind(found(text, HEX), 2))).alias(base),
        _of_kind(_entropy_spans(text), 3).alias("__more"),
    )
    return parts.select(*rest, base, _uncovered(F.sort_array(F.concat(base, "__more"))).alias(every))


def as_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by the mark; null stays null."""

    def gaps(v):
        """What lies between the runs: from the end of all spans so far to the next start beyond it."""
        reach = running(F.transform(v["spans"], lambda x: x["end"]), F.greatest)
        starts = F.concat(F.transform(v["spans"], lambda x: x["start"]), F.array(v["length"]))
        ends = F.concat(F.array(F.lit(0)), reach)
        each = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
        return F.filter(each, lambda x, i: (x["start"] <= x["end"]))

    between = let(F.struct(spans.alias("spans"), F.length(text).alias("length")), gaps)
    return F.when(F.size(spans) > 0, F.array_join(pieces(text, between), mark)).otherwise(text)
