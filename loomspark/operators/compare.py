"""Pairs of texts, rerankers, and choices among candidates: small helpers in Arrow batches where no expression does it."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts; null texts are empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType())]))
def line_changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many lines a unified diff adds and removes."""
    out = []
    for x, y in zip(a, b, strict=True):
        codes = difflib.SequenceMatcher(None, (x or "").splitlines(), (y or "").splitlines(), autojunk=False).get_opcodes()
        out.append((sum(j2 - j1 for t, _, _, j1, j2 in codes if t in ("insert", "replace")), sum(i2 - i1 for t, i1, i2, _, _ in codes if t in ("delete", "replace"))))
    return pd.DataFrame(out, columns=["added", "removed"])


def diverse(candidates: DataFrame, k: int = 8, trade: float = 0.5) -> DataFrame:
    """query_id, id, pick: maximal marginal relevance among a query's candidates (query_id, id, score, v: vector), a few dozen each."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        near, score, picked = m @ m.T, pdf["score"].to_numpy(), []
        while len(picked) < min(k, len(pdf)):
            gain = trade * score - (1 - trade) * (near[:, picked].max(1) if picked else 0)
            gain[picked] = -np.inf
            picked.append(int(np.round(gain, 9).argmax()))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": pdf["id"].to_numpy()[picked], "pick": np.arange(1, len(picked) + 1, dtype=np.int32)})

    return candidates.groupBy("query_id").applyInPandas(choose, "query_id long, id long, pick int")


def hash_embedding(rows: DataFrame, key: str, tokens: Column, dims: int = 384, most: int | None = None) -> DataFrame:
    """key, bucket, weight, dropped: the entries of a signed hashing embedding of length 1 of each row's tokens, by md5. With most, of its
    first ones alone, in the order given; dropped tells how many tokens are beyond them."""
    named = rows.select(key, tokens.alias("t"), F.lit(0).alias("dropped"))
    if most is not None:
        named = named.select(key, F.slice("t", 1, most).alias("t"), F.greatest(F.size("t") - most, F.lit(0)).alias("dropped"))
    each = named.select(key, "dropped", F.explode("t").alias("t")).select(key, "dropped", F.md5("t").alias("h"))
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("long")
    sums = each.select(key, "dropped", (number(1, 8) % dims).cast("int").alias("bucket"), F.when(number(9, 1) >= 8, -1).otherwise(1).alias("sign")).groupBy(key, "bucket").agg(F.sum("sign").alias("s"), F.max("dropped").alias("dropped"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.join(norms, key).where("s <> 0").select(key, "bucket", F.round(F.col("s") / F.col("norm"), 6).alias("weight"), "dropped")
