"""Exact dense search: blocks of queries against blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.lexical import best, ranked

#: Rows and queries whose products one task holds as a matrix (8 bytes each).
ROWS, QUERIES = 5_000, 2_000


def _unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, as a matrix, and the lengths they had."""
    matrix = np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])
    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.maximum(norms, 1e-300)[:, None], norms


def _near(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    own, ids = rows.column("id").to_numpy(), asked.column("query_id").to_numpy()
    found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    scores = np.zeros((len(own), len(ids)))
    if len(own) and len(ids):
        (vectors, norms), (wanted, _) = _unit(rows.column("v")), _unit(asked.column("v"))
        scores = np.round(vectors @ wanted.T, 6)
        for i in range(len(ids)):
            top = best(scores[:, i], np.flatnonzero((own != ids[i]) & (norms > 0)), own, k)
            found.append(top)
            of.append(np.full(len(top), i))
    found, of = np.concatenate(found), np.concatenate(of)
    return pa.table({"query_id": pa.array(ids[of], pa.int64()), "id": pa.array(own[found], pa.int64()), "score": pa.array(scores[found, of])})


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score (cosine, 6 decimals), rank: the k nearest rows of each query (key, vector), itself left out.

    Blocks of queries meet blocks of rows; a pair of blocks gives k rows per query at most, and those are ranked.
    Null vectors and vectors of length zero are near nothing.
    """
    some = F.col(vector).isNotNull()
    p, q = max(1, -(-vectors.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = vectors.where(some).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), mine(p).alias("p"), every(q).alias("q"))
    asked = queries.where(some).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("v"), every(p).alias("p"), mine(q).alias("q"))
    found = rows.groupBy("p", "q").cogroup(asked.groupBy("p", "q")).applyInArrow(lambda a, b: _near(a, b, k), "query_id long, id long, score double")
    return ranked(found, "query_id", "id", k=k).withColumnRenamed("id", key)
