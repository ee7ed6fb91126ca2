"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word by word.

A window is ``size`` consecutive words of an item (the whole item if it has fewer, but not none). Its tokens are its
shingles of three words (of all its words, if it has fewer). A document holds a window only if it holds all of its shingles,
the rarest of them too: one shingle, the rarest in the corpus, is the prefix that a containment of 100 % asks for. Each
place of a prefix in a document puts the window in one place there (positional bound); the place must lie inside the
document (length bound) and hold the window's words exactly (verification).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.spans import let
from loomspark.llm.words import folded_words
from loomspark.session import checkpointed

#: Words of a shingle. Shingles are known by a 64-bit hash; what it lets through by accident is verified like all else.
SHINGLE = 3
#: Up to so many shingles of windows are asked for in each text as a set (8 bytes each); more are joined.
SET_SHINGLES = 50_000
#: A table of windows or of their shingles is sent to all tasks up to so many bytes, else joined by a shuffle.
BROADCAST_BYTES = 64_000_000


def windows_of(items: DataFrame, size: int = 10) -> DataFrame:
    """words (array) and item_ids (array, sorted): the distinct windows of items (item_id, text), and whose they are.

    Items without a word or with a null id have none; an item that comes twice counts once.
    """
    words = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), folded_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = words.where(F.size("w") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return each.distinct()


def _sized(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if its rows, of so many bytes each and 50 more, are few enough."""
    total = df.agg(F.coalesce(F.sum(size + 50), F.lit(0)).alias("n")).first()["n"]  # one number
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _shingles(words: Column, length: int) -> Column:
    """Array of structs (pos, s): the hash of the shingle that begins at each word."""
    return F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.xxhash64(F.lit(length), w, *[F.get(words, i + j) for j in range(1, length)]).alias("s")))


def _holding(words: Column, lengths: list[int], wanted: list[int] | None) -> Column:
    """The shingles of a text of those lengths that are in the set, or all without one."""
    each = [_shingles(words, n) for n in lengths]
    return F.concat(*[x if wanted is None else F.filter(x, lambda p: p["s"].isin(wanted)) for x in each])


def _wanted(shingles: DataFrame) -> list[int] | None:
    """The shingles (one column, distinct) if they are few enough to be asked for as a set."""
    found = [r[0] for r in shingles.limit(SET_SHINGLES + 1).collect()]
    return found if len(found) <= SET_SHINGLES else None


def counted(docs: DataFrame, shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """s, n: how often each of the shingles (v) comes in the documents; those that never come are missing."""
    wanted = _wanted(shingles)
    held = let(folded_words(F.col("text").cast("string")), lambda words: F.transform(_holding(words, lengths, wanted), lambda x: x["s"]))
    each = docs.select(F.explode(held).alias("s"))
    if wanted is None:
        each = each.join(_sized(shingles, F.lit(8)), F.col("s") == F.col("v"), "left_semi")
    return each.groupBy("s").agg(F.count("*").alias("n"))


def hits(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frame of doc_id, h (hash of the text) and, for each place of a window in a document, start, stop (0-based, exclusive) and
    window; frame of doc_id, h, n_words of each row of docs; and the windows of items.

    Texts are cut into words twice: for the counts of the windows' shingles, and for the join. Of a text only the places
    of prefixes, with the words about them, leave its row.
    """
    per_item = checkpointed(windows_of(items, size))
    windows = checkpointed(per_item.select("words").distinct())
    lengths = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]  # 1, 2 or 3
    placed = F.lit(None).cast("array<struct<pos:int,s:bigint>>")
    for n in lengths:
        whole = F.slice(_shingles(F.col("words"), n), 1, F.size("words") - (n - 1))
        placed = F.when(F.least(F.size("words"), F.lit(SHINGLE)) == n, whole).otherwise(placed)
    tokens = checkpointed(windows.select("words", F.explode(placed).alias("x")).select("words", F.col("x.pos").alias("at"), F.col("x.s").alias("v")))
    counts = checkpointed(counted(docs, tokens.select("v").distinct(), lengths))
    # A window with a shingle that no document has can't occur; it needs no place in the join.
    ranked = tokens.join(_sized(counts, F.lit(16)), F.col("v") == F.col("s"), "left")
    prefix = ranked.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "v", "at")).alias("x"))
    prefix = checkpointed(prefix.where("x.n > 0").select(F.col("words").alias("window"), F.col("x.v").alias("rarest"), F.col("x.at").alias("at")))
    rarest = checkpointed(prefix.select("rarest").distinct())
    wanted = _wanted(rarest)

    text = F.col("text").cast("string")

    def about(words: Column) -> Column:
        """The number of words, and the places of prefixes with the words that a window can have before and after them."""
        around = lambda x: F.slice(words, F.greatest(x["pos"] - size + 2, F.lit(1)), 2 * size - 1)
        places = F.transform(_holding(words, lengths, wanted), lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"), around(x).alias("around")))
        return F.struct(F.size(words).cast("long").alias("n_words"), places.alias("about"))

    rows = docs.select("doc_id", F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), let(folded_words(text), about).alias("x")).select("doc_id", "h", "x.*")
    if wanted is not None:
        rows = checkpointed(rows)
    places = rows.select("doc_id", "h", "n_words", F.explode("about").alias("x")).select("doc_id", "h", "n_words", "x.*")
    if wanted is None:
        places = places.join(_sized(rarest.withColumnRenamed("rarest", "r"), F.lit(8)), F.col("s") == F.col("r"), "left_semi")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    first = start - F.greatest(F.col("pos") - size + 1, F.lit(0))
    same = F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size("window")) == F.col("window")
    bytes_of = F.aggregate("window", F.lit(0), lambda n, w: n + F.octet_length(w) + 20)
    found = places.join(_sized(prefix, bytes_of), (F.col("s") == F.col("rarest")) & fits & same)
    return found.select("doc_id", "h", start.alias("start"), (start + F.size("window")).alias("stop"), "window"), rows.select("doc_id", "h", "n_words"), per_item


def contaminated(found: DataFrame, per_item: DataFrame) -> DataFrame:
    """doc_id, h, n_hit (words in an occurrence of a window), item_ids (sorted strings; items of which a window occurs) of each
    (doc_id, text) in which any does, from hits()."""
    found = checkpointed(found)
    places = found.select("doc_id", "h", "start", "stop").distinct()
    # Number of words under the union of the places: each adds what lies beyond all those before it.
    last = F.expr("max(stop) over (partition by doc_id, h order by start, stop rows between unbounded preceding and 1 preceding)")
    added = places.select("doc_id", "h", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(last, F.lit(0)))).alias("n"))
    n_hit = added.groupBy("doc_id", "h").agg(F.sum("n").cast("long").alias("n_hit"))
    # Windows that the same items have count once for a document, and bring their items as one list.
    owners = checkpointed(per_item.groupBy(F.col("words").alias("window_of")).agg(F.array_sort(F.collect_set("item_id")).alias("ids")))
    owners = owners.select("window_of", "ids", F.xxhash64("ids").alias("owner"))
    size = F.aggregate("window_of", F.lit(0), lambda n, w: n + F.octet_length(w) + 20)
    pairs = found.select("doc_id", "h", "window").join(_sized(owners.select("window_of", "owner"), size), F.col("window") == F.col("window_of")).select("doc_id", "h", "owner").distinct()
    lists = owners.groupBy(F.col("owner").alias("o")).agg(F.first("ids").alias("ids"))
    ids_size = F.aggregate("ids", F.lit(0), lambda n, x: n + F.octet_length(x) + 20)
    named = pairs.join(_sized(lists, ids_size), F.col("owner") == F.col("o")).groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    both = _keyed(n_hit, "a").join(_keyed(named, "b"), F.col("a_id").eqNullSafe(F.col("b_id")) & (F.col("a_h") == F.col("b_h")))
    return both.select(F.col("a_id").alias("doc_id"), F.col("a_h").alias("h"), "n_hit", "item_ids")


def _keyed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": f"{name}_id", "h": f"{name}_h"})


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def judged(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """A row for each row of docs: doc_id, h, n_words, n_hit, n_items, item_ids (sorted strings); equal rows give equal rows.

    h is a 64-bit hash of the text, which tells rows of one doc_id apart. A document word is hit if it lies in an
    occurrence of a window; an item is counted if one of its windows occurs. Null and empty texts have no words.
    """
    found, rows, per_item = hits(docs, items, size)
    bad = _keyed(contaminated(found, per_item), "f")
    out = rows.join(bad, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, all their columns as they were, in which no window of an item occurs."""
    found, _, per_item = hits(docs, items, size)
    bad = contaminated(found, per_item).select(F.col("doc_id").alias("__bad_id"), F.col("h").alias("__bad_h"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (text_hash(docs["text"]) == F.col("__bad_h")), "left_anti")


def duckdb_sql(size: int = 10) -> str:
    """The contract's columns for DuckDB, every window against every run of as many words."""
    from loomspark.llm.words import LOWER, UPPER

    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, text, {words} AS w FROM documents),
    i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, w[s:s + least(len(w), {size}) - 1] AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    runs AS (SELECT doc_id, text, s, n, w[s:s + n - 1] AS ws FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT len(ws) AS n FROM win) WHERE len(w) >= n)),
    hits AS (SELECT doc_id, text, s, n, item_id FROM runs JOIN win USING (ws)),
    pos AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1, 2),
    its AS (SELECT doc_id, text, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1, 2)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos ON pos.doc_id IS NOT DISTINCT FROM d.doc_id AND pos.text IS NOT DISTINCT FROM d.text LEFT JOIN its ON its.doc_id IS NOT DISTINCT FROM d.doc_id AND its.text IS NOT DISTINCT FROM d.text"""
