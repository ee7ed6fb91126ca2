"""BM25 over code-aware tokens, for many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import code_tokens
from loomspark.functions.tokens import counted
from loomspark.session import checkpointed

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents and queries whose scores one task holds as a matrix (8 bytes each).
DOCS, QUERIES = 1_000, 1_000
#: Up to so many different tokens of queries are sent to all tasks (some 50 bytes each); more are joined by a shuffle.
BROADCAST_TOKENS = 500_000
#: Queries of up to so many bytes of tokens are sent to all tasks, which score the documents where they lie.
BROADCAST_BYTES = 32 << 20
#: Pairs of a document and a query's token that a task adds up at once.
PAIRS = 4_000_000
#: Documents times tokens of texts that a task marks at once (a byte each).
CELLS = 32 << 20


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, dl: a row per distinct token of each document, dl being how many of them it has."""
    return docs.select(key, code_tokens(F.col(text)).alias("tokens")).select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))


class Index:
    """Tokens of the documents, cut once, and the weight of each token over all of them.

    tokens: key, the carried columns, tokens (array). weights: token, idf; a token in more than half of all documents has the
    weight epsilon times the mean weight. Both lie in the checkpoint folder or, if the index was written, in its own.
    """

    def __init__(self, tokens: DataFrame, weights: DataFrame, key: str):
        self.tokens, self.weights, self.key = tokens, weights, key
        stats = tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(1.0)).alias("avgdl")).first()  # two numbers
        self.n, self.avgdl = stats["n"], stats["avgdl"] or 1.0
        self._single: bool | None = None

    def single(self) -> bool:
        """Whether each key comes once: asked once, of the keys alone."""
        if self._single is None:
            self._single = not self.tokens.groupBy(self.key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        return self._single

    @classmethod
    def of(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> Index:
        rows = docs.select(key, *carry, F.col(text).alias("__text"))
        # A small table may be one group of rows in one file: its texts are dealt out, so that all cores cut them. Large ones lie in many parts as they are.
        cores = docs.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows
        both = checkpointed(counted(rows, "__text"))
        tokens = both.where("many is null").select(key, *carry, "tokens")
        n = tokens.count()
        each = both.where("many is not null").select(F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("many").alias("many"))))
        held = each.groupBy("token").agg(F.sum("many").alias("df"))
        raw = checkpointed(held.select("token", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
        mean = raw.agg(F.avg("idf")).first()[0] or 0.0  # one number
        return cls(tokens, raw.select("token", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")).alias("idf")), key)

    def write(self, folder: str, docs: DataFrame, text: str = "text") -> None:
        """Stores the index with a fingerprint of the documents that it was made of."""
        self.tokens.write.mode("overwrite").parquet(f"{folder}/tokens")
        self.weights.write.mode("overwrite").parquet(f"{folder}/weights")
        fingerprint(docs, self.key, text).write.mode("overwrite").parquet(f"{folder}/fingerprint")

    @classmethod
    def read(cls, folder: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index | None:
        """A stored index, or None if the documents are no longer those that it was made of."""
        spark = docs.sparkSession
        if spark.read.parquet(f"{folder}/fingerprint").first() != fingerprint(docs, key, text).first():
            return None
        return cls(spark.read.parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/weights"), key)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n, mark: one row that changes with any row of the documents, whatever their order."""
    each = F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("\0")))
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("mark"))


def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each row's place in the list of distinct values, the list, and the values' places in ascending order (null first)."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    values = coded.dictionary
    order = np.empty(len(values), np.int64)
    order[pc.sort_indices(values, null_placement="at_start").to_numpy()] = np.arange(len(values))
    return coded.indices.to_numpy(zero_copy_only=False), values, order


def best(column: np.ndarray, some: np.ndarray, ties: np.ndarray, k: int | None) -> np.ndarray:
    """Of the places ``some`` those of the k highest values, highest first, ties by the least of ``ties``."""
    if k is not None and len(some) > k:
        edge = np.partition(column[some], len(some) - k)[len(some) - k]
        some = some[column[some] >= edge]
    return some[np.lexsort((ties[some], -column[some]))][:k]


def _matrix(hits: pa.Table, asked: pa.Table, key: str, query_key: str, within: str | None, k: int | None) -> pa.Table:
    """Scores of a block of documents for a block of queries, the best k of each query (and group) alone."""
    words = pc.unique(asked.column("token"))
    number, keys, ties = _numbered(hits.column(key))
    group, groups, _ = _numbered(hits.column(within)) if within else (np.zeros_like(number), pa.array([None]), None)
    # A document is a key in a group; a key that comes several times in one is one document.
    each, docs = np.unique(number.astype(np.int64) * max(1, len(groups)) + group, return_inverse=True)
    number, group = np.divmod(each, max(1, len(groups)))
    ties = ties[number]
    asks, names, _ = _numbered(asked.column(query_key))
    n, m = len(each), len(names)
    scores = np.zeros((n, m))

    def cells(table, owner, size, value):
        """token, owner and summed value of each pair, by token."""
        token = pc.index_in(table.column("token"), words).to_numpy(zero_copy_only=False)
        value = table.column(value).to_numpy()
        some = ~np.isnan(token.astype(float))
        pair, at = np.unique(token[some].astype(np.int64) * size + owner[some], return_inverse=True)
        return pair // size, pair % size, np.bincount(at, value[some], len(pair))

    token, doc, weight = cells(hits, docs, n, "w")
    of, query, idf = cells(asked, asks, m, "idf")
    edges, query_edges = (np.searchsorted(x, np.arange(len(words) + 1)) for x in (token, of))
    for t in np.unique(token):
        a, b = slice(edges[t], edges[t + 1]), slice(query_edges[t], query_edges[t + 1])
        scores[np.ix_(doc[a], query[b])] += np.outer(weight[a], idf[b])
    scores = np.round(scores, 6)
    parts = [np.flatnonzero(group == g) for g in np.unique(group)]
    rows, columns = [], []
    for q in range(m):
        for part in parts:
            top = best(scores[:, q], part[scores[part, q] > 0], ties, k)
            rows.append(top)
            columns.append(np.full(len(top), q))
    rows, columns = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (rows, columns))
    out = {query_key: names.take(pa.array(columns)), key: keys.take(pa.array(number[rows]))}
    if within:
        out[within] = groups.take(pa.array(group[rows]))
    return pa.table(out | {"score": pa.array(scores[rows, columns])})


def _high(scores: np.ndarray, group: np.ndarray, k: int | None) -> np.ndarray:
    """The places of all scores above 0 that are no lower than the k-th of their column and group; ties stay in."""
    over = scores > 0
    for g in np.flatnonzero(np.bincount(group) > k) if k is not None else ():
        rows = np.flatnonzero(group == g)
        own = scores[rows]
        over[rows] &= own >= np.partition(own, len(rows) - k, axis=0)[len(rows) - k]
    return np.flatnonzero(over)


def _beside(index: Index, rows: DataFrame, asked: DataFrame, query_key: str, within: str | None, k: int | None, schema: str) -> DataFrame:
    """Scores of all rows of the index for queries that every task has: nothing of the corpus moves but what is found."""
    table = asked.select(query_key, "token", "idf").toArrow()  # of a size that was measured
    told = rows.sparkSession.sparkContext.broadcast(table)
    key, names = index.key, [x.split()[0] for x in schema.split(", ")]
    own = [key] + ([within] if within else [])

    def score(batches):
        asked = told.value
        words = pc.unique(asked.column("token"))
        of, labels, _ = _numbered(asked.column(query_key))
        token = pc.index_in(asked.column("token"), words).to_numpy(zero_copy_only=False)
        order = np.argsort(token, kind="stable")
        of, idf, edges = of[order], asked.column("idf").to_numpy()[order], np.searchsorted(token[order], np.arange(len(words) + 1))
        m = len(labels)
        for batch in batches:
            n = batch.num_rows
            held = batch.column("tokens")
            sizes = pc.fill_null(held.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(held.flatten(), words), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n), sizes)[found >= 0]
            found = found[found >= 0]
            w, many = batch.column("w").to_numpy(), edges[found + 1] - edges[found]
            # Documents in stretches whose pairs fit.
            cuts = np.flatnonzero(np.diff(np.cumsum(np.bincount(doc, many, n)) // PAIRS)) + 1
            number, keys, ties = _numbered(pa.chunked_array([batch.column(key)]))
            group, groups, _ = _numbered(pa.chunked_array([batch.column(within)])) if within else (np.zeros(n, np.int64), pa.array([None]), None)
            for a, b in zip([0, *cuts], [*cuts, n], strict=True):
                lo, hi = np.searchsorted(doc, (a, b))
                each = many[lo:hi]
                if not each.sum():
                    continue
                at = np.repeat(edges[found[lo:hi]] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
                row = np.repeat(doc[lo:hi], each) - a
                if (b - a) * m <= 2 * len(at):  # most documents meet most queries: a matrix takes no more room than the pairs, and needs no sort
                    value = np.round(np.bincount(row * m + of[at], idf[at] * w[row + a], (b - a) * m), 6)
                    pair = _high(value.reshape(b - a, m), group[a:b], k)
                    value = value[pair]
                else:
                    pair, place = np.unique(row * m + of[at], return_inverse=True)
                    value = np.round(np.bincount(place, idf[at] * w[row + a]), 6)
                    pair, value = pair[value > 0], value[value > 0]
                d, q = a + pair // m, pair % m
                # The best k of each query and group: by query, group, falling score, key.
                order = np.lexsort((ties[number[d]], -value, group[d], q))
                d, q, value = d[order], q[order], value[order]
                if k is not None and len(d):
                    first = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(group[d], prepend=-1) != 0))
                    place = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
                    d, q, value = d[place < k], q[place < k], value[place < k]
                out = [labels.take(pa.array(q)), keys.take(pa.array(number[d]))] + ([groups.take(pa.array(group[d]))] if within else [])
                yield pa.RecordBatch.from_arrays([*out, pa.array(value)], names)

    dl = F.size("tokens")
    weight = (K1 + 1) / (1 + K1 * (1 - B + B * dl / index.avgdl))
    return rows.select(*own, weight.cast("double").alias("w"), "tokens").mapInArrow(score, schema)


def scored(index: Index, queries: DataFrame, query_key: str = "item_id", query_text: str = "text", k: int | None = None, where: Column | None = None, within: str | None = None) -> DataFrame:
    """query_key, key, (within,) score (6 decimals): documents that share a token with a query and score above 0.

    A token counts once per document. With k, no fewer than the k best of each query (and value of within, a carried column)
    are among them. where: the documents that may be found; weights are those of all. Queries of a measured size go to all tasks, which
    score the documents where they lie; of more, or where a key comes several times, blocks of documents meet blocks of queries, and only tokens of queries are moved.
    """
    key, own = index.key, [index.key] + ([within] if within else [])
    asked = queries.select(query_key, F.explode(code_tokens(F.col(query_text))).alias("token"))
    used = checkpointed(index.weights.join(asked.select("token").distinct(), "token", "left_semi"))
    asked = asked.join(used, "token")
    rows = index.tokens if where is None else index.tokens.where(where)
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(queries, query_key), *[kind(index.tokens, c) for c in own], "score double"])
    size = asked.agg(F.coalesce(F.sum(F.octet_length("token") + 24), F.lit(0))).first()[0]  # one number
    if size <= BROADCAST_BYTES and index.single():
        return _beside(index, rows, asked, query_key, within, k, schema)
    n_used, n_queries = used.count(), queries.count()
    dl = F.size("tokens")
    rows = rows.select(*own, ((K1 + 1) / (1 + K1 * (1 - B + B * dl / index.avgdl))).alias("w"), F.explode("tokens").alias("token"))
    names = used.select("token")
    hits = rows.join(F.broadcast(names) if n_used <= BROADCAST_TOKENS else names, "token", "left_semi")
    p, q = max(1, -(-index.n // DOCS)), max(1, -(-n_queries // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hits = hits.select("*", F.pmod(F.xxhash64(key), F.lit(p)).cast("int").alias("p"), every(q).alias("q"))
    asked = asked.select("*", every(p).alias("p"), F.pmod(F.xxhash64(query_key), F.lit(q)).cast("int").alias("q"))
    return hits.groupBy("p", "q").cogroup(asked.groupBy("p", "q")).applyInArrow(lambda a, b: _matrix(a, b, key, query_key, within, k), schema)


def _all_of(asked: pa.Table, text: str, key: str):
    """The task of ``holding`` for texts that every task has: only documents with a text's rarest token are compared with its others."""
    codes, texts, _ = _numbered(asked.column(text))
    known = asked.column("idf").is_valid().to_numpy()
    named = asked.column("token").is_valid().to_numpy()
    lost = np.bincount(codes, named & ~known, len(texts)) > 0  # a token that no document has
    every = np.flatnonzero(~lost & (np.bincount(codes, named, len(texts)) == 0))  # texts without tokens
    some = named & ~lost[codes]
    words = pc.unique(asked.column("token").filter(pa.array(some)))
    token = pc.index_in(asked.column("token"), words).to_numpy(zero_copy_only=False)[some].astype(np.int64)
    of, idf = codes[some].astype(np.int64), asked.column("idf").to_numpy()[some]
    order = np.lexsort((token, -idf, of))
    token, of = token[order], of[order]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    with_any = np.flatnonzero(np.diff(first))
    with_any = with_any[np.argsort(token[first[with_any]], kind="stable")]  # texts by their rarest token
    edges = np.searchsorted(token[first[with_any]], np.arange(len(words) + 1))
    step = max(1, CELLS // max(1, len(words)))

    def held(batches):
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                n, tokens = batch.num_rows, batch.column("tokens")
                sizes = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.fill_null(pc.index_in(tokens.flatten(), words), -1).to_numpy(zero_copy_only=False)
                doc, found = np.repeat(np.arange(n), sizes)[found >= 0], found[found >= 0]
                has = np.zeros((n, len(words)), bool)
                has[doc, found] = True
                many = edges[found + 1] - edges[found]
                ask = with_any[np.repeat(edges[found] - np.append(0, np.cumsum(many))[:-1], many) + np.arange(many.sum())]
                doc = np.repeat(doc, many)
                for nth in range(1, int(np.diff(first).max(initial=1))):
                    at = first[ask] + nth
                    stay = at >= first[ask + 1]
                    stay[~stay] = has[doc[~stay], token[at[~stay]]]
                    doc, ask = doc[stay], ask[stay]
                doc, ask = np.append(doc, np.tile(np.arange(n), len(every))), np.append(ask, np.repeat(every, n))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(doc)), texts.take(pa.array(ask))], [key, text])

    return held


def holding(index: Index, texts: DataFrame, text: str, tokens: Column | None = None) -> DataFrame:
    """key, text: the documents that have all tokens of a text (or those given), all documents where it has none; null holds nothing.

    Where a key comes several times, its documents may be taken together: what is named has to be compared with the text itself."""
    key = index.key
    asked = texts.where(F.col(text).isNotNull()).select(text, F.explode_outer(code_tokens(F.col(text)) if tokens is None else tokens).alias("token")).distinct()
    asked = checkpointed(asked.join(index.weights, "token", "left").select(text, "token", "idf"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length(text) + F.coalesce(F.octet_length("token"), F.lit(0)) + 24), F.lit(0))).first()[0]  # one number
    if size <= BROADCAST_BYTES:
        schema = f"{key} {index.tokens.schema[key].dataType.simpleString()}, {text} string"
        task = asked.toArrow()  # of a size that was measured
        return index.tokens.select(key, "tokens").mapInArrow(lambda batches: _all_of(task, text, key)(batches), schema)
    n = asked.groupBy(text).agg(F.count("token").alias("n"))
    pairs = index.tokens.select(key, F.explode("tokens").alias("token")).join(asked.select(text, "token"), "token").groupBy(text, key).agg(F.count("*").alias("has"))
    some = pairs.join(n, text).where("has >= n").select(key, text)
    return some.unionByName(index.tokens.select(key).crossJoin(n.where("n = 0").select(text)))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_key, key, score (6 decimals) of all documents that score above 0."""
    return scored(Index.of(docs, key, text), queries, query_key, query_text)


def search(
    docs: DataFrame | Index, queries: DataFrame, k: int, query_key: str = "item_id", query_text: str = "text", where: Column | None = None, within: str | None = None
) -> DataFrame:
    """query_key, key, (within,) score, rank: the k best documents of each query (and value of within), ties by key.

    where (over carried columns) comes before the ranks: it is the documents that are searched."""
    index = docs if isinstance(docs, Index) else Index.of(docs)
    found = scored(index, queries, query_key, query_text, k, where, within)
    return ranked(found, [query_key, within] if within else query_key, index.key, k=k)


def ranked(scored: DataFrame, by: str | list[str], key: str, score: str = "score", k: int | None = None) -> DataFrame:
    """scored with rank (1, 2, ...) in each group, highest score first, ties by key; the first k of each."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))).cast("int"))
    return out.where(F.col("rank") <= k) if k else out
