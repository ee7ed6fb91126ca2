"""Quality rules whose cutoffs come with a guarantee.

Each rule measures a share in [0, 1] of a text (symbols, capitals, repeated lines, repeated words) and rejects
texts above a cutoff. Strata are languages; those with too few labels form one stratum together. A quarter of the
documents that people labelled as good, and all that they labelled as bad, choose what to try: for each rule cutoffs
that catch half, 90 % and 99 % of the bad documents that it can catch without harm, rules in the order of how many that
is, rules that add nothing left out. That gives each stratum one path of ever stricter sets of cutoffs. The other good
documents are the holdout: along the path the exact binomial probability of as few false rejections as were seen, were
the true rate ``alpha``, must be at most delta / strata, and the walk stops at the first set that fails
(fixed-sequence testing inside a stratum, Bonferroni over strata). So with probability 1 - delta no stratum loses more
than ``alpha`` of its good documents to all rules together. Where labels are too few to prove anything, no rule rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.words import SPACE, UPPER, plain_words
from loomspark.session import checkpointed

#: Rule and its numerator and denominator, columns of features().
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Steps of the grid of cutoffs: a cutoff is a whole number of hundredths.
STEPS = 100
#: Shares of the bad documents that a rule can catch, by which its cutoffs are chosen, loosest first.
RUNGS = (0.5, 0.9, 0.99)
#: A rule that catches less than this share of a stratum's bad documents, beyond those before it, is left out.
WORTH = 0.01
#: One of so many good labels is for the choice, the others are the holdout.
TUNING = 4
#: The stratum of languages with too few labels.
POOLED = "(other)"
#: Up to so many labelled languages are named to all tasks (some 60 bytes each); more are joined by a shuffle.
BROADCAST_LANGS = 100_000
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found at least twice, in place: windows are hashed to 64 bits,
    sorted with their positions, and those beside an equal hash are spread over their three words."""
    last = F.size(words) - 3
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )
    return F.when(last > 0, windows)


def _covered(windows: Column) -> Column:
    """Words under the windows that share their hash with a neighbour in the sorted array."""
    same = F.filter(windows, lambda x, j: (F.get(windows, j - 1)["h"] == x["h"]) | (F.get(windows, j + 1)["h"] == x["h"]))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("p"))
    return F.aggregate(
        starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["p"])).alias("n"), i.alias("p")), lambda a: a["n"]
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each row of docs, in one pass without a shuffle.

    A null text is an empty one: all counts are 0. Equal rows give equal rows. Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    pieces = pieces.select(
        "doc_id",
        "lang",
        plain_words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", UPPER, ""))).cast("long").alias("n_capitals"),
    )
    pieces = pieces.select("*", _repeat_words(F.col("words")).alias("windows"))
    return pieces.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("windows")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _step(rule: str) -> Column:
    """The share in hundredths, rounded up: it is above a cutoff of c hundredths exactly if this is above c."""
    over, under = RULES[rule]
    share = F.expr(f"({STEPS} * {over} + {under} - 1) div greatest({under}, 1)")
    return F.when(F.col(under) > 0, F.least(share, F.lit(STEPS))).otherwise(F.lit(0)).cast("int")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Bin(n, p), exact: terms follow from each other in logarithms, so that none is lost."""
    from math import log, log1p

    def more(a, i):
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(log(p) - log1p(-p))
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(a["total"], term) - top))).alias("total"))

    first = (n * F.lit(log1p(-p))).cast("double")
    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.filter(F.sequence(F.lit(0).cast("long"), k.cast("long")), lambda i: i > 0)
    return F.exp(F.aggregate(steps, start, more, lambda a: a["total"]))


def needed(alpha: float, level: float) -> int:
    """Good documents that a holdout must have for no false rejection at all to prove a rate below alpha."""
    from math import ceil, log, log1p

    return ceil(log(level) / log1p(-alpha))


def _labelled(counts: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """doc_id, lang, stratum, part (bad, tuning or holdout) and steps (an array, by rule) of labelled documents that pass the base rule.

    Rows with a null in either column of labels are not used; of several for a document the lowest quality holds."""
    judged_by = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    tuning = F.pmod(F.xxhash64("doc_id"), F.lit(TUNING)) == 0
    part = F.when(F.col("quality") != 1, "bad").when(tuning, "tuning").otherwise("holdout")
    held = counts.where(~_base_failed()).join(judged_by, F.col("doc_id") == F.col("label_id"))
    held = checkpointed(held.select("doc_id", "lang", part.alias("part"), F.array(*[_step(r) for r in RULES]).alias("steps")))
    per = held.groupBy("lang").agg(F.count_if(F.col("part") == "holdout").alias("n"))
    enough = needed(alpha, delta / (per.count() + 1))
    per = per.select(F.col("lang").alias("of"), F.when(F.col("n") >= enough, F.col("lang")).otherwise(POOLED).alias("stratum"))
    return held.join(per, F.col("lang") == F.col("of")).drop("of")


def _paths(held: DataFrame, alpha: float) -> DataFrame:
    """stratum, path: array of structs (rule: place in RULES, cutoff), loosest first; chosen without the holdout."""
    some = held.where("part <> 'holdout'").select("stratum", "part", F.posexplode("steps").alias("rule", "step"))
    seen = some.groupBy("stratum", "rule", "step").agg(F.count_if(F.col("part") == "tuning").alias("good"), F.count_if(F.col("part") == "bad").alias("bad"))
    # From here on a row per stratum, rule and step at most, however many documents there are.
    by_rule = seen.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("step", "good", "bad")).alias("steps"))
    grid = by_rule.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("cutoff"))
    none = F.lit(0).cast("long")
    above = lambda kind: F.aggregate("steps", none, lambda a, x: a + F.when(x["step"] > F.col("cutoff"), x[kind]).otherwise(none))
    grid = grid.select("stratum", "rule", "cutoff", "n_good", above("good").alias("rejected"), above("bad").alias("caught"))
    harmless = grid.where((F.col("caught") > 0) & (F.col("rejected") <= alpha / 2 * F.col("n_good")))
    tried = harmless.groupBy("stratum", "rule").agg(F.max("caught").alias("most"), F.collect_list(F.struct("cutoff", "caught")).alias("grid"))
    loosest = lambda share: F.array_max(F.transform(F.filter("grid", lambda x: x["caught"] >= share * F.col("most")), lambda x: x["cutoff"]))
    rungs = tried.select("stratum", "rule", "most", F.explode(F.array_distinct(F.array(*[loosest(q) for q in RUNGS]))).alias("cutoff"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("most")).alias("o"), "rule", (-F.col("cutoff")).alias("c"))))
    paths = rungs.groupBy("stratum").agg(order.alias("x"))
    paths = paths.select("stratum", F.transform("x", lambda x: F.struct(x["rule"].alias("rule"), (-x["c"]).alias("cutoff"))).alias("path"))
    # A bad document counts for the first rule that catches it.
    first = held.where("part = 'bad'").join(paths.withColumnRenamed("stratum", "s"), F.col("stratum") == F.col("s"))
    first = first.select("stratum", F.get("path", _first("steps", "path"))["rule"].alias("rule")).groupBy("stratum", "rule").agg(F.count("*").alias("n"))
    worth = first.groupBy(F.col("stratum").alias("s")).agg(F.collect_list(F.struct("rule", "n")).alias("rules"), F.sum("n").alias("n_bad"))
    good = F.transform(F.filter("rules", lambda x: x["rule"].isNotNull() & (x["n"] >= WORTH * F.col("n_bad"))), lambda x: x["rule"])
    worth = worth.select("s", good.alias("good"))
    return paths.join(worth, F.col("stratum") == F.col("s")).select("stratum", F.filter("path", lambda x: F.array_contains("good", x["rule"])).alias("path"))


def _first(steps: str, path: str) -> Column:
    """The first place of the path whose rule rejects a document of those steps; null if none does."""
    places = F.transform(path, lambda x, i: F.when(F.get(steps, x["rule"]) > x["cutoff"], i))
    return F.array_min(places)


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """lang, stratum, rule, cutoff (hundredths), n_good and n_rejected (of the stratum's holdout, by all its cutoffs together),
    p_value: the cutoffs that the labels prove, for each language that has labels.

    Labels: doc_id, quality (1 good, 0 bad). Documents that fail the base rule never reach the method's rules and don't count.
    """
    held = checkpointed(_labelled(counts, labels, alpha, delta))
    paths = checkpointed(_paths(held, alpha).where(F.size("path") > 0))
    strata = max(1, held.select("stratum").distinct().count())
    tested = held.where("part = 'holdout'").join(paths.withColumnRenamed("stratum", "s"), F.col("stratum") == F.col("s"))
    tested = tested.groupBy("stratum", _first("steps", "path").alias("at")).agg(F.count("*").alias("n"))
    tested = tested.groupBy(F.col("stratum").alias("s")).agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("at", "n")).alias("hits"))
    upto = lambda i: F.aggregate(F.filter("hits", lambda x: x["at"] <= i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    walk = tested.join(paths, F.col("stratum") == F.col("s")).select("stratum", "n_good", F.posexplode(F.transform("path", lambda x, i: F.struct(x["rule"], x["cutoff"], upto(i).alias("n_rejected")))).alias("at", "x"))
    walk = walk.select("stratum", "n_good", "at", "x.*")
    # More rejections than the limit's mean can't prove a lower rate; the sum is spared.
    p_value = F.when(F.col("n_rejected") <= F.col("n_good") * alpha, binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha)).otherwise(F.lit(1.0))
    walk = walk.select("*", p_value.alias("p_value"))
    # p-values grow along the path with the rejections, so those before the first failure are all that pass.
    proven = walk.where(F.col("p_value") <= delta / strata)
    last = proven.groupBy(F.col("stratum").alias("s")).agg(F.max_by(F.struct("n_rejected", "p_value", "n_good"), "at").alias("joint"))
    names = F.array(*[F.lit(r) for r in RULES])
    rules = proven.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")).join(last, F.col("stratum") == F.col("s"))
    rules = rules.select("s", F.get(names, F.col("rule")).alias("rule"), "cutoff", "joint.n_good", "joint.n_rejected", "joint.p_value")
    return held.select("lang", "stratum").distinct().join(rules, F.col("stratum") == F.col("s")).drop("s")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """A row for each row of docs: doc_id, lang, the counts, base_failed, kept and rejected_by (rules, comma-joined).

    Without labels, or for a lang that has none or whose stratum has too few, the base rule alone decides.
    """
    counts = checkpointed(features(docs))  # narrow rows; the texts are read once
    limits = checkpointed(cutoffs(counts, labels, alpha, delta))
    wide = limits.groupBy(F.col("lang").alias("of")).pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = checkpointed(wide.select("of", *[F.col(r).alias(f"limit_{r}") for r in RULES]))
    small = wide.count() <= BROADCAST_LANGS
    joined = counts.join(F.broadcast(wide) if small else wide, F.col("lang") == F.col("of"), "left")
    broken = F.concat_ws(",", *[F.when(_step(r) > F.col(f"limit_{r}"), F.lit(r)) for r in RULES])
    return joined.select(*counts.columns, _base_failed().alias("base_failed"), broken.alias("rejected_by")).select(
        "*", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept")
    )
