"""Collocations by a weighted de Bruijn graph: counts of phrases from the flow through nodes of shared words.

Each word of a text begins one edge: the phrase of four words from it on, or the shorter one that its piece has left. Edges lead between
nodes of three words that overlap, and are counted over the corpus. What flows out of a node, together with the phrases that end
in it with their piece, is the node's own count; nodes of two words and of one get theirs from those in turn. So the corpus is
counted for one length, and the shorter counts are sums over the graph.

A phrase can come 30 times only if its words, its pairs of neighbours and its triples do. These are counted first, triples of such pairs after
the pairs; bounded sieves tell them to all tasks, and before a pair or triple that is too rare the edge ends, like at the end of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.names import BASES, Sieve, U, Words, as_batch, dealt, gathered, mixed, share_for, slices
from loomspark.session import checkpointed

LONGEST = 4
#: Names that a task holds before it sums them up and passes them on.
HELD = 4_000_000
#: Words whose strings a task remembers to have told.
TOLD = 300_000
_ENDS = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(256)])
_INSIDE = ~_ENDS & np.array([chr(b) not in " \t" for b in range(256)])
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_EDGE = np.dtype([*((w, "<u8") for w in WORDS), ("n", "<i8")])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("code"), text.cast("binary").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words, np.ndarray, np.ndarray]]:
    """Of each slice the languages of its texts, its words, their names within their language, and whether the next word is of the same piece."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text").to_pylist(), _INSIDE, low=True)
            code = part.column("code").to_numpy().view(np.uint64)
            name = mixed(words.name * BASES[1] + code[words.text]) | U(1)
            piece = np.cumsum(_ENDS[words.data])[words.start]
            yield part.column("lang").to_pylist(), words, name, np.append(piece[1:] == piece[:-1], False)[: len(name)]


def _run(name: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """The name of the m words from each place on."""
    out = name[at]
    for k in range(1, m):
        out = out * BASES[0] + name[at + k] * BASES[1]
    return mixed(out)


def _possible(name: np.ndarray, near: np.ndarray, sieves: list[Sieve]) -> list[np.ndarray]:
    """Whether the word, the pair and (with two sieves) the triple that begin at each place may come often enough."""
    one = sieves[0].holds(_run(name, np.arange(len(name)), 1))
    out = [one]
    last, holds = one, near
    for m in range(2, len(sieves) + 2):
        longer = last & holds & np.append(last[1:], False)[: len(name)]
        at = np.flatnonzero(longer)
        longer[at] = sieves[max(0, m - 2)].holds(_run(name, at, m))
        out.append(longer)
        last = longer
    return out


def _counted(names: list[np.ndarray], counts: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    name = np.concatenate(names)
    if not len(name):
        return name, np.zeros(0, "<i8")
    order = np.argsort(name)
    name = name[order]
    at = np.flatnonzero(np.diff(name, prepend=~name[:1]))
    n = np.diff(np.append(at, len(name))) if counts is None else np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at)
    return name[at], n.astype("<i8")


def often(texts: DataFrame, least: int, n_words: int, known: list[Sieve]) -> Sieve:
    """The sieve of words and pairs of neighbours that come so often or, where that is known, of triples.

    In its bucket a name is told by the 32 digits after those that all names of the bucket have: more names than a sieve tells apart.
    """
    share, size = share_for(n_words), Sieve.bits_for(n_words // max(1, least))
    out = pa.schema([("bucket", pa.int32()), ("name", pa.binary()), ("n", pa.binary())])
    told = texts.sparkSession.sparkContext.broadcast(known)

    def passed(held: list[np.ndarray]) -> pa.RecordBatch:
        name, n = _counted(held, None)
        short = (name >> U(32 - share)).astype("<u4")
        return as_batch(list(dealt((name >> U(64 - share)).astype(np.int64), {"name": short, "n": n.astype("<u4")})), out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for _, _, name, near in _parts(batches):
            if told.value:
                pair = _possible(name, near, told.value)[1]
                held.append(_run(name, np.flatnonzero(pair[:-1] & pair[1:]), 3))
            else:
                held += [_run(name, np.arange(len(name)), 1), _run(name, np.flatnonzero(near), 2)]
            many = sum(len(x) for x in held)
            if many > HELD:
                yield passed(held)
                held, many = [], 0
        if many:
            yield passed(held)

    def tell(table: pa.Table) -> pa.Table:
        short, n = _counted([gathered(table, "name", "<u4")], [gathered(table, "n", "<u4")])
        name = short[n >= least].astype(U) << U(32 - share)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": [Sieve.segment(name, size, share)]})

    found = texts.mapInArrow(count, "bucket int, name binary, n binary").groupBy("bucket").applyInArrow(tell, "bucket int, bits binary")
    return Sieve.joined({r["bucket"]: bytes(r["bits"]) for r in found.collect()}, size, share)  # 2 ** size bits in all


def _summed(edges: np.ndarray) -> np.ndarray:
    """Each edge once. They are told apart by words; where digests meet, those are sorted as well."""
    digest = _digest(edges)
    order = np.argsort(digest)
    unlike = lambda e: np.logical_or.reduce([e[w][1:] != e[w][:-1] for w in WORDS])
    if (unlike(edges[order]) & (digest[order][1:] == digest[order][:-1])).any():
        order = np.lexsort([*(edges[w] for w in WORDS), digest])
    edges = edges[order]
    at = np.flatnonzero(np.append(True, unlike(edges))[: len(edges)])
    out = edges[at].copy()
    out["n"] = np.add.reduceat(edges["n"], at)
    return out


def _digest(edges: np.ndarray) -> np.ndarray:
    out = np.zeros(len(edges), U)
    for w in WORDS:
        out = mixed(out * BASES[0] + edges[w])
    return out


def edges(texts: DataFrame, sieves: list[Sieve], n_words: int) -> DataFrame:
    """w1 ... w4 (names; 0 after the phrase), n, lang, word: the counts of edges, and for each word that may come often enough a row of count 0
    with its language and string. Rows of w1 = 0 have the words of a language in all."""
    share = share_for(n_words // 4)
    told = texts.sparkSession.sparkContext.broadcast(sieves)
    out = pa.schema([("bucket", pa.int32()), ("edges", pa.binary()), ("name", pa.binary()), ("n", pa.binary()), ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.binary()))])
    none = {"edges": b"", "name": b"", "n": b"", "lang": [], "word": []}

    def passed(found: np.ndarray) -> Iterator[dict]:
        for row in dealt((_digest(found) >> U(64 - share)).astype(np.int64), {"edges": found}):
            yield none | row

    def single(name: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Edges of one word: they come again and again, so they are held as names until there are too many."""
        found = np.zeros(len(name), _EDGE)
        found["w1"], found["n"] = name, n
        return found

    def named(names: list[int], n: list[int], langs: list[str], words: list[bytes]) -> Iterator[dict]:
        name = np.array(names, U)
        for row in dealt((mixed(name) >> U(64 - share)).astype(np.int64), {"name": name, "n": np.array(n, "<i8"), "at": np.arange(len(n))}):
            at = np.frombuffer(row.pop("at"), np.int64)
            yield none | row | {"lang": [langs[i] for i in at], "word": [words[i] for i in at]}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, alone, many = [], [], 0
        known: set[int] = set()
        totals: dict[str, int] = {}
        for langs, words, name, near in _parts(batches):
            for t, n in enumerate(np.diff(words.at).tolist()):
                totals[langs[t]] = totals.get(langs[t], 0) + n
            some, pair, triple = _possible(name, near, told.value)
            first = np.flatnonzero(pair)
            found = np.zeros(len(first), _EDGE)
            found["n"] = 1
            for k, (w, on) in enumerate(zip(WORDS, (some, pair, triple, triple & np.append(triple[1:], False)[: len(triple)]), strict=True)):
                reach = on[first]
                found[w][reach] = name[first[reach] + k]
            held.append(found)
            many += len(found)
            alone.append(np.unique(name[some & ~pair], return_counts=True))
            distinct, at = np.unique(name[some], return_index=True)
            places = np.flatnonzero(some)
            fresh = [(x, places[i]) for x, i in zip(distinct.tolist(), at.tolist(), strict=True) if x not in known]
            if fresh:
                if len(known) > TOLD:
                    known.clear()
                known.update(x for x, _ in fresh)
                strings = [words.data[words.start[i] : words.end[i]].tobytes() for _, i in fresh]
                yield as_batch(list(named([x for x, _ in fresh], [0] * len(fresh), [langs[words.text[i]] for _, i in fresh], strings)), out)
            if many > HELD // 3:
                yield as_batch(list(passed(_summed(np.concatenate(held)))), out)
                held, many = [], 0
            if sum(len(x) for x, _ in alone) > HELD // 4:
                alone = [_counted([x for x, _ in alone], [n for _, n in alone])]
                if len(alone[0][0]) > HELD // 8:
                    yield as_batch(list(passed(single(*alone[0]))), out)
                    alone = []
        if many:
            yield as_batch(list(passed(_summed(np.concatenate(held)))), out)
        if alone:
            yield as_batch(list(passed(single(*_counted([x for x, _ in alone], [n for _, n in alone])))), out)
        if totals:
            yield as_batch(list(named([0] * len(totals), list(totals.values()), list(totals), [b""] * len(totals))), out)

    def add(table: pa.Table) -> pa.Table:
        found = _summed(np.frombuffer(b"".join(table.column("edges").to_pylist()), _EDGE))
        name, n = gathered(table, "name", "<u8").tolist(), gathered(table, "n", "<i8").tolist()
        strings: dict[tuple, list] = {}
        for key, k, word in zip(zip(name, (x for y in table.column("lang").to_pylist() for x in y), strict=True), n, (x for y in table.column("word").to_pylist() for x in y), strict=True):
            strings.setdefault(key, [0, word])[0] += k
        signed = lambda w: np.concatenate((found[w], np.array([k[0] for k in strings] if w == "w1" else [0] * len(strings), U))).view(np.int64)
        columns = {w: pa.array(signed(w)) for w in WORDS}
        columns["n"] = pa.array(np.concatenate((found["n"], np.array([x for x, _ in strings.values()], np.int64))))
        columns["lang"] = pa.array([None] * len(found) + [k[1] for k in strings], pa.string())
        columns["word"] = pa.array([None] * len(found) + [w for _, w in strings.values()], pa.binary())
        return pa.table(columns)

    found = texts.mapInArrow(ask, "bucket int, edges binary, name binary, n binary, lang array<string>, word array<binary>")
    return found.groupBy("bucket").applyInArrow(add, ", ".join(f"{w} long" for w in WORDS) + ", n long, lang string, word binary")


def flows(counted: DataFrame, least: int) -> DataFrame:
    """w1 ... w4, n of each phrase of one to four words that comes so often: the edges, and the nodes of three, two and one words, each with all that
    leaves it or ends in it."""
    longest = counted.where(F.col(WORDS[-1]) != 0).select(*WORDS, "n")
    node = lambda k: F.struct(*[(F.col(w) if i < k else F.lit(0).cast("long")).alias(w) for i, w in enumerate(WORDS)])
    passed = F.array_compact(F.array(*[F.when(F.col(WORDS[k - 1]) != 0, node(k)) for k in range(1, LONGEST)]))
    nodes = counted.select("n", F.explode(passed).alias("x")).groupBy("x").agg(F.sum("n").alias("n")).select("x.*", "n")
    return longest.union(nodes).where(F.col("n") >= least)


def _part(start: int, end: int) -> list[Column]:
    """The words of a phrase from one place to another, then zeros."""
    return [F.col(WORDS[start + i]) if start + i < end else F.lit(0).cast("long") for i in range(LONGEST)]


def _cuts(phrases: DataFrame) -> DataFrame:
    """Each phrase of m words with each place k at which it can be cut, and the words of both sides."""
    cut = lambda m, k: F.struct(F.lit(k).alias("k"), F.array(*_part(0, k)).alias("left"), F.array(*_part(k, m)).alias("right"))
    every = F.coalesce(*[F.when(F.col("m") == m, F.array(*[cut(m, k) for k in range(1, m)])) for m in range(2, LONGEST + 1)])
    return phrases.select(*WORDS, "m", "a", F.explode(every).alias("x")).select(*WORDS, "m", "a", "x.*")


def _inner(phrases: DataFrame) -> DataFrame:
    """The phrases within each phrase that are shorter than it, with its count."""
    parts = lambda m: F.array(*[F.array(*_part(i, j)) for i in range(m) for j in range(i + 2, m + 1) if j - i < m])
    every = F.coalesce(*[F.when(F.col("m") == m, parts(m)) for m in range(3, LONGEST + 1)])
    found = phrases.where("m > 2").select("a", F.explode(every).alias("p"))
    return found.groupBy("p").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, within: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two to four words by score, count and bytes.

    Texts with A-Z lowered are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. a, l, r count a phrase and the two sides of its
    cut, n all words of the language; the score is floor(2000000 a / (l + r)) at the cut where it is least, the first such. Phrases that come less
    than ``least`` times, or lie in a longer one that comes ``within`` hundredths as often, are left out. A null language is ``und``, a null text empty;
    a language without phrases has no rows. Other columns aren't read. Words are told apart by 64-bit digests.
    """
    texts = _texts(docs)
    n_words = (texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] or 0) // 6  # one number, for sizes alone
    sieves: list[Sieve] = []
    for _ in range(2):
        sieves.append(often(texts, least, n_words, sieves))
    every = checkpointed(edges(texts, sieves, n_words))
    totals = every.where("w1 = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where("w1 <> 0 and word is not null").select(F.col("w1").alias("w"), "lang", F.col("word").cast("string").alias("word"))
    counts = checkpointed(flows(every.where("w1 <> 0"), least))
    m = sum((F.when(F.col(w) != 0, 1).otherwise(0) for w in WORDS[1:]), F.lit(1))
    phrases = counts.select(*WORDS, m.alias("m"), F.col("n").alias("a")).where("m > 1")
    sides = counts.select(F.array(*WORDS).alias("p"), F.col("n").alias("f"))

    side = lambda name, f: sides.select(F.col("p").alias(name), F.col("f").alias(f))
    cut = _cuts(phrases).join(side("left", "l"), "left").join(side("right", "r"), "right")
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    scored = cut.groupBy(*WORDS, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select(*WORDS, "a", "x.score", "x.l", "x.r")
    inner = _inner(phrases)
    free = scored.withColumn("p", F.array(*WORDS)).join(inner, "p", "left").where(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * within, F.lit(True)))
    first = words.select(F.col("w").alias("w1"), "lang", F.col("word").alias("s1"))
    ranked = free.drop("p", "longer").join(first, "w1")
    # Those that can be among the first of a language, ties included, before the other words are fetched.
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = checkpointed(ranked.withColumn("place", F.rank().over(by)).where(F.col("place") <= top).drop("place"))
    for i, w in enumerate(WORDS[1:], 2):
        near = near.join(words.select(F.col("w").alias(w), F.col("word").alias(f"s{i}")), w, "left")
    near = near.withColumn("phrase", F.concat_ws(" ", *[f"s{i}" for i in range(1, LONGEST + 1)])).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def duckdb_sql(least: int = 30, within: int = 80, top: int = 2000) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sub = " UNION ALL ".join(f"SELECT lang, words[{i}:{j}] AS words, a FROM c WHERE len(words) >= {j} AND len(words) > {j - i + 1}" for i in range(1, LONGEST) for j in range(i + 1, LONGEST + 1) if j - i + 1 < LONGEST)
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    s AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM p),
    t AS (SELECT lang, sum(len(ws)) AS n FROM s GROUP BY lang),
    g AS (SELECT lang, ws[i:i + m - 1] AS words FROM s, unnest(range(1, len(ws) + 1)) AS x(i), unnest(range(1, {LONGEST + 1})) AS y(m) WHERE i + m - 1 <= len(ws)),
    f AS (SELECT lang, words, count(*) AS a FROM g GROUP BY lang, words HAVING count(*) >= {least}),
    c AS (SELECT * FROM f WHERE len(words) > 1),
    k AS (SELECT c.lang, c.words, c.a, x.k, l.a AS l, r.a AS r, (c.a::HUGEINT * 2000000) // (l.a + r.a) AS score
          FROM c, unnest(range(1, len(c.words))) AS x(k) JOIN f l ON l.lang = c.lang AND l.words = c.words[:x.k] JOIN f r ON r.lang = c.lang AND r.words = c.words[x.k + 1:]),
    best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
    sub AS (SELECT lang, words, max(a) AS longer FROM ({sub}) GROUP BY lang, words),
    free AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, words) WHERE longer IS NULL OR 100 * longer < {within} * best.a),
    o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, score FROM free)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM o JOIN t USING (lang) WHERE rank <= {top}"""
