"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Letters of the basic plane by code point; the few above it are asked one by one.
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, the text of each, and which texts hold a letter.

    Texts are lowered; each run of characters that aren't letters counts as one blank; n-grams stay within a text
    and those of blanks alone are left out.
    """
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        letter[i] = chr(points[i]).isalpha()
    owner = np.repeat(np.arange(len(texts)), lengths)
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    if len(points):
        keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first other character after a letter
    points, owner, letter = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    found, whose = [], []
    rolling = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            inside = owner[: len(rolling)] == owner[n - 1 :]
            if n == 1:
                inside &= letter
            found.append((_spread(rolling[inside] + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int32))
            whose.append(owner[: len(rolling)][inside])
    return np.concatenate(found), np.concatenate(whose), has


def _bytes_bound(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Runs of a batch of about so many characters: memory stays bounded by that and the longest text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


class Model:
    """langs, and the log-probability of each bucket in each of them (buckets by langs)."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest lang of each text and its share of the probability, tempered by the text's length so that
        it stays below 1 where langs are close; ``und`` and 0 for a text without letters."""
        langs, scores = [], []
        for part in _bytes_bound(texts):
            some = texts[part]
            buckets, whose, has = grams(some)
            counts = np.maximum(np.bincount(whose, minlength=len(some)), 1)
            sums = np.stack([np.bincount(whose, self.weights[:, k][buckets], len(some)) for k in range(len(self.langs))], 1)
            odds = (sums - sums.max(1, keepdims=True)) / np.sqrt(counts)[:, None]
            share = np.exp(odds)
            share /= share.sum(1, keepdims=True)
            best = sums.argmax(1)
            langs += [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, has, strict=True)]
            scores += list(np.where(has, share[np.arange(len(some)), best], 0.0))
        return langs, np.array(scores)


def fit(labelled: DataFrame, per_lang: int = 4000, smoothing: float = 0.5) -> Model:
    """Learn from the rows (text, lang, key) of labelled, about ``per_lang`` documents of each lang at most.

    Where a lang has more, a fraction is taken by a hash of ``key`` and text, so that the same rows come at every run. Rows with
    a null text or lang teach nothing. Counts are summed by Spark; the driver gets one array of buckets per lang.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", "key")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    taken = labelled.where(F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                mine = [t for t, of in zip(texts, langs, strict=True) if of == lang]
                for part in _bytes_bound(mine):
                    totals[lang] = totals.get(lang, 0) + np.bincount(grams(mine[part])[0], minlength=BUCKETS)
        for lang, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": row[at].astype(np.int64)})

    counted = taken.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    table = np.full((BUCKETS, max(1, len(langs))), smoothing)
    for row in counted.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toLocalIterator():
        table[np.array(row["b"], np.int64), langs.index(row["lang"])] += np.array(row["n"], float)
    return Model(langs or [UNDETERMINED], np.log(table / table.sum(0)))


def identified(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two columns added, row for row: the language and its score; columns of their names in docs are replaced.

    Null and empty texts and texts without a letter get ``und`` and 0. The model is broadcast: its size is buckets x langs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.score([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    rest = [c for c in docs.columns if c not in (lang, score)]
    found = docs.select(*rest, predict(F.col("text").cast("string")).alias("__found"))
    return found.select(*rest, F.col("__found.lang_pred").alias(lang), F.col("__found.score").alias(score))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def fitted_on(docs: DataFrame, held_out: int = 2) -> Model:
    """The model of all rows of docs but those of the held-out fold."""
    train = docs.where(fold(F.col("doc_id")) != held_out)
    return fit(train.select("text", F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("key")))
