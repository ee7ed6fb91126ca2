"""Near duplicates by DartMinHash over weighted shingles, banded joining and exact verification.

A text is a weighted set of 5-word shingles; a shingle's weight is how often it comes. Weight and rank span a plane in
which each shingle owns the strip up to its weight. Hashing throws about one dart into each unit square of a strip; a dart
has a rank and a coordinate. The earliest dart of each coordinate is the signature: two texts agree in a coordinate with
the probability of their weighted Jaccard similarity. Throwing stops when all coordinates are hit, after
about max(weight, k ln k) darts, where plain weighted minhash takes k times the weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.components import components
from loomspark.session import checkpointed

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Documents, and shingles, of a group that one task compares with as many others: a task holds some 60 MB of shingles. They
#: grow with the input beyond GROUPS groups that are larger, so that no more than twice as many are named to all tasks.
BLOCK, UNITS, GROUPS = 2_000, 4_000_000, 50_000
#: Up to so many documents of groups are named to all tasks at once (some 40 bytes each); more are joined by a shuffle.
BROADCAST_DOCS = 500_000

U = np.uint64
_BYTE_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_BYTE_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = U(0x9E3779B97F4A7C15)
#: Chances of more than 0, 1, 2 ... darts in a unit square: the tail of the Poisson distribution of mean 1.
_MORE = 1 - np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), _BASE, U), dtype=U)


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit weights of all texts as hashes, the text of each (ascending), and a 64-bit digest of each text's words.

    Words are those of the contracts with A-Z lowered. A text of fewer than five words, but not none, is one shingle. The
    c-th coming of a shingle is a unit of its own. A text without words has none, and a digest of its characters.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = _BYTE_LOW[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    inside = _BYTE_WORD[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    power = _powers(int(lengths.max(initial=1)))
    values = (data[kept].astype(U) + U(1)) * power[place]
    words = mixed(np.add.reduceat(values, first) + lengths.astype(U)) if len(first) else np.zeros(0, U)
    owner = np.searchsorted(begin, starts, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    at = np.concatenate(([0], np.cumsum(n_words)[:-1]))

    digest = np.zeros(len(texts), U)
    index = np.arange(len(words)) - at[owner]
    np.add.at(digest, owner, mixed(words + (index.astype(U) + U(1)) * _BASE))
    digest = mixed(digest + n_words.astype(U))
    for i in np.flatnonzero(n_words == 0):
        digest[i] = mixed(np.sum((np.frombuffer(raw[i], np.uint8).astype(U) + U(1)) * _powers(len(raw[i]))[: len(raw[i])], dtype=U) + U(7))

    full = max(0, len(words) - WORDS + 1)
    grams = np.zeros(full, U)
    for j in range(WORDS):
        grams = grams * _BASE + words[j : j + full]
    whole = owner[:full] == owner[WORDS - 1 :][:full]
    grams, of = grams[whole], owner[:full][whole]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    grams, of = mixed(np.concatenate((grams, digest[short]))), np.concatenate((of, short))

    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    run = np.flatnonzero(new)
    again = np.arange(len(grams)) - np.repeat(run, np.diff(np.append(run, len(grams))))
    return mixed(grams + again.astype(U) * U(0xD1B54A32D192ED03)), of, digest


def signatures(units: np.ndarray, of: np.ndarray, n: int, k: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Earliest dart per coordinate (texts by k) of each text's units, and which texts have units at all."""
    weight = np.bincount(of, minlength=n)
    none = np.iinfo(np.uint64).max
    best = np.full(n * k, none, U)
    enough = k * (np.log(k) + 5)
    rounds = np.where(weight > 0, np.ceil(enough / np.maximum(weight, 1)), 0).astype(np.int64)
    rank = 0
    active, who = units, of
    while True:
        go = rounds[who] > rank
        active, who = active[go], who[go]
        if not len(active):  # texts that miss a coordinate throw on, from where they stopped
            empty = np.flatnonzero((best.reshape(n, k) == none).any(1) & (weight > 0)) if n else []
            if not len(empty):
                break
            rounds[empty] = rank + np.maximum(rank, 1)
            again = np.isin(of, empty)
            active, who = units[again], of[again]
            continue
        square = mixed(active + U((rank + 1) * 0xA24BAED4963EE407 % 2**64))
        chance = square.astype(np.float64) / 2.0**64
        left, owner = square, who
        for number, more in enumerate(_MORE):
            hit = chance < more
            if not hit.any():
                break
            left, owner, chance = left[hit], owner[hit], chance[hit]
            dart = mixed(left + U((number + 1) * 0x9FB21C651E98DF25 % 2**64))
            coordinate = (dart >> U(44)) % U(k)
            value = (U(min(rank, 2**15)) << U(48)) | (dart & U(0xFFFFFFFFFFFF))  # rank in whole, then its fraction
            np.minimum.at(best, owner * k + coordinate.astype(np.int64), value)
        rank += 1
    return best.reshape(n, k), weight > 0


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = best.reshape(len(best), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * _BASE, (len(best), BANDS)).copy()
    for j in range(ROWS):
        out = mixed(out * _BASE + parts[:, :, j])
    return out.view(np.int64)


def _parts(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text."""
    sizes = np.array([len(x or "") for x in batch.column(column).to_pylist()], np.int64)
    marks = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *marks], [*marks, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), c (digest of its words), w (units of weight), b0 ... (band keys; null without words) of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                units, of, digest = cells([t or "" for t in part.column("text").to_pylist()])
                best, some = signatures(units, of, part.num_rows)
                keys = band_keys(best)
                columns = [pa.array(keys[:, j], mask=~some) for j in range(BANDS)]
                weight = pa.array(np.bincount(of, minlength=part.num_rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(digest.view(np.int64)), weight, *columns], names)

    names = ["doc_id", "h", "c", "w", *[f"b{j}" for j in range(BANDS)]]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(sketch, ", ".join(f"{n} long" for n in names))


def similarity(first: list[str], second: list[str]) -> np.ndarray:
    """Exact weighted Jaccard similarity of texts, pair by pair; 0 where one has no words."""
    a, of_a, _ = cells(first)
    b, of_b, _ = cells(second)
    n = len(first)
    cut_a, cut_b = np.searchsorted(of_a, np.arange(n + 1)), np.searchsorted(of_b, np.arange(n + 1))
    out = np.zeros(n)
    for i in range(n):
        x, y = a[cut_a[i] : cut_a[i + 1]], b[cut_b[i] : cut_b[i + 1]]
        common = len(np.intersect1d(x, y, assume_unique=True))
        out[i] = common / max(1, len(x) + len(y) - common)
    return out


def _named(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """c, w and units (the unit weights as sorted 64-bit hashes) of the nodes (c, w, doc_id, h), from the document that stands for each."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                units, of, _ = cells([t or "" for t in part.column("text").to_pylist()])
                ends = np.cumsum(np.bincount(of, minlength=part.num_rows))
                each = [np.sort(x).tobytes() for x in np.split(units, ends[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("c"), part.column("w"), pa.array(each, pa.binary())], ["c", "w", "units"])

    wanted = nodes.select("c", "w", F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"))
    small = wanted.count() <= BROADCAST_DOCS
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = rows.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    # A document that comes several times gives the same units each time.
    return found.select("c", "w", "text").mapInArrow(sort, "c long, w long, units binary").groupBy("c").agg(F.first("w").alias("w"), F.first("units").alias("units"))


def _groups(nodes: DataFrame) -> DataFrame:
    """g, c, near, w: groups of documents (c) that share a band with the document g, which is the most central one, that which
    shares groups of bands with most others (near), of some band's group; g is in its own group.

    All of a band's group come to the same g, so any two that share a band share a g.
    """
    keys = F.array(*[F.col(f"b{j}") for j in range(BANDS)])
    banded = nodes.where(F.col("b0").isNotNull()).select("c", "w", F.explode(keys).alias("key"))
    groups = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = checkpointed(banded.join(groups, "key"))
    central = rows.groupBy("c").agg(F.sum("members").alias("near"))
    rows = checkpointed(rows.join(central, "c").select("key", "c", "w", "near"))
    lead = rows.groupBy("key").agg(F.max(F.struct("near", "c")).alias("x")).select("key", F.col("x.c").alias("g"))
    return checkpointed(rows.join(lead, "key").select("g", "c", "near", "w").distinct())


def _compared(table: pa.Table, least: float) -> pa.Table:
    """a, b: rows that ask and rows of other components in their group that are at least so similar, one of each component."""
    table = table.sort_by("g")
    g, c, comp, w, asks = (table.column(x).to_numpy(zero_copy_only=False) for x in ("g", "c", "comp", "w", "asks"))
    units = [np.frombuffer(x, U) for x in table.column("units").to_pylist()]
    found = []
    marks = np.flatnonzero(np.diff(g)) + 1
    for a, b in zip([0, *marks], [*marks, len(g)], strict=True):
        ask, others = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
        if not len(ask) or not len(others):
            continue
        # Units are numbered; those of one document are marked, and the marks under each other document are its common units.
        sizes = np.array([len(units[i]) for i in (*others, *ask)])
        names, number = np.unique(np.concatenate([units[i] for i in (*others, *ask)]), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(sizes)))
        held = number[: begin[len(others)]]
        marked = np.zeros(len(names), bool)
        for i, o in enumerate(ask, len(others)):
            own = number[begin[i] : begin[i + 1]]
            marked[own] = True
            common = np.add.reduceat(marked[held], begin[: len(others)], dtype=np.int64)
            marked[own] = False
            close = others[(common / np.maximum(1, w[others] + w[o] - common) >= least) & (comp[others] != comp[o])]
            close = close[np.unique(comp[close], return_index=True)[1]]
            found.append(np.stack((np.full(len(close), c[o]), c[close]), 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _links(asking: DataFrame, all_: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """a, b: for each row (g, c, comp, w) that asks, rows of its group in other components whose exact similarity is at least so
    great, one at least of each component that has any.

    Small groups share tasks. A large one is cut into blocks of rows that ask and blocks of others, and each pair of blocks
    is a task; no pairs but links leave it.
    """
    total = all_.agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()  # two numbers
    block, limit = max(BLOCK, total["n"] // GROUPS), max(UNITS, total["w"] // GROUPS)
    packs = max(1, total["n"] // (block // 2 + 1), total["w"] // (limit // 2 + 1))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("w") / limit)).cast("int")
        return df.groupBy("g").agg(size.alias(name)).withColumnRenamed("g", f"g_{name}")

    large = blocks(all_, "alls").where("alls > 1").join(blocks(asking, "outs"), F.col("g_alls") == F.col("g_outs")).select(F.col("g_alls").alias("large"), "alls", "outs")
    large = checkpointed(large)

    def dealt(df: DataFrame, asks: bool, mine: str, other: str) -> DataFrame:
        rows = df.join(F.broadcast(large), F.col("g") == F.col("large"), "left")  # at most 2 GROUPS rows
        pack = F.coalesce("large", F.pmod(F.xxhash64("g"), F.lit(packs)))
        own = F.pmod(F.xxhash64("c"), F.coalesce(mine, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        rows = rows.select("g", "c", "comp", F.lit(asks).alias("asks"), pack.alias("pack"), own.alias(mine), every.alias(other))
        return rows.join(units, "c").select("g", "c", "comp", "w", "units", "asks", "pack", "outs", "alls")

    rows = dealt(asking, True, "outs", "alls").unionByName(dealt(all_, False, "alls", "outs"))
    return rows.groupBy("pack", "outs", "alls").applyInArrow(lambda table: _compared(table, least), "a long, b long")


def _apart(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """g, c, near, w, comp, out: the groups whose documents are of several components; out: not of the one that has most of the group."""
    named = groups.join(labels.withColumnRenamed("v", "c"), "c", "left").select("g", "c", "near", "w", F.coalesce("comp", "c").alias("comp"))
    named = checkpointed(named)
    counted = named.groupBy("g", "comp").agg(F.count("*").alias("n"))
    mixed = counted.groupBy(F.col("g").alias("g2")).agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("most")).where("comps > 1")
    joined = named.join(mixed, F.col("g") == F.col("g2"))
    return checkpointed(joined.select("g", "c", "near", "w", "comp", (F.col("comp") != F.col("most.comp")).alias("out")))


def linked(docs: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """v, comp: the components of the links among nodes; a node without a link may be missing.

    All of a group meet its central document. What that leaves outside the group's largest component sends one document,
    the most central, to meet the others; then all that is still outside meets all others of the group. Similarities are exact
    throughout, so that the only links that can be lost are those of pairs that share no band.
    """
    groups = _groups(nodes)
    units = checkpointed(_named(docs, nodes.join(groups.select("c").distinct(), "c")))
    alone = groups.select("g", "c", "w", F.col("c").alias("comp"))
    edges = checkpointed(_links(alone.where("g = c"), alone, units, least))
    labels = components(edges)
    for last in (False, True):
        apart = _apart(groups, labels)
        out = apart.where("out")
        if not out.limit(1).count():
            break
        if not last:
            out = out.groupBy("g").agg(F.max_by(F.struct("c", "comp", "w"), F.struct("near", "c")).alias("x")).select("g", "x.*")
        more = checkpointed(_links(out.select("g", "c", "comp", "w"), apart.select("g", "c", "comp", "w"), units, least))
        if more.limit(1).count():
            edges = edges.union(more)
            labels = components(edges)
    return labels


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, h (hash of the text), class_id, class_size, keeps.

    Texts with the same words are copies and stand in for each other. Of the others, pairs that share a band and are at least
    so similar are links, and classes are the components of links. class_id is the least doc_id of the class (null if
    it has none), class_size counts rows, keeps tells the one document that stays (repeated rows of it all say so). A null
    text is an empty one; texts without words are copies of equal texts alone.
    """
    rows = checkpointed(sketched(docs))
    keys = [f"b{j}" for j in range(BANDS)]
    nodes = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("x"), F.count("*").alias("n"), *[F.first(k).alias(k) for k in ("w", *keys)])
    nodes = checkpointed(nodes.select("c", F.col("x.doc_id").alias("doc_id"), F.col("x.h").alias("h"), "n", "w", *keys))
    labels = linked(docs, nodes, least)
    whole = nodes.join(labels.withColumnRenamed("v", "c"), "c", "left").select("c", F.coalesce("comp", "c").alias("comp"), "doc_id", "h", "n")
    whole = checkpointed(whole)
    heads = whole.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")).alias("x"), F.sum("n").cast("long").alias("class_size"))
    by_node = whole.select("c", "comp").join(heads, "comp").select("c", F.col("x.doc_id").alias("class_id"), F.col("x.h").alias("class_h"), "class_size")
    out = rows.select("doc_id", "h", "c").join(by_node, "c")
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    return out.select("doc_id", "h", "class_id", "class_size", keeps.alias("keeps"))


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all their columns as they were, of the one document that stays of each class; a row that
    comes several times comes once."""
    found = checkpointed(classes(docs, least).where("keeps").groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.count("*").alias("__n")))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    kept = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__h")))
    if not found.where("__n > 1").limit(1).count():
        return kept.select(*[docs[c] for c in docs.columns])
    once = kept.where("__n = 1").select(*[docs[c] for c in docs.columns])
    return once.unionByName(kept.where("__n > 1").dropDuplicates(["__id", "__h"]).select(*[docs[c] for c in docs.columns]))
