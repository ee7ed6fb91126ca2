"""Hard negatives against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, score double"


def brute(rows, every=100, positives=5, negatives_=5, low=80, scale=256):
    sound = {}
    for i, v, g in rows:
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) <= 65536 for x in v):
            sound[(i, g, tuple(math.floor(scale * x) for x in v))] = v
    anchors = {}
    for i, g, q in sound:
        if i % every == 0:
            anchors[i] = max(anchors.get(i, (g, q)), (g, q))
    out = []
    for i, (g, q) in anchors.items():
        scored = {(-sum(a * b for a, b in zip(q, p, strict=False)), j, h == g) for j, h, p in sound if j != i}
        same = sorted((s, j) for s, j, is_same in scored if is_same)[:positives]
        others = sorted((s, j) for j, h, p in sound if h != g for s in [-sum(a * b for a, b in zip(q, p, strict=False))])
        others = sorted(set(others))
        for s, j in same:
            fit = [(n, m) for n, m in others if low * -s <= 100 * -n <= 100 * -s][:negatives_]
            out += [(i, j, r, m, -s, -n) for r, (n, m) in enumerate(fit, 1)]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, v, g, 1, 0.5) for i, v, g in rows], SCHEMA).repartition(5)
    out = negatives.mined(df, **how)
    assert out.columns == [x.split()[0] for x in negatives.SCHEMA.split(", ")]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(150)]  # one vector many times: ties by id
    rows += [rows[0], rows[0], rows[7], (None, [1.0] * 4, 1), (3, None, 1), (4, [1.0, None, 1.0, 1.0], 1), (5, [1.0] * 4, None), (6, [math.nan] * 4, 0), (8, [math.inf] * 4, 0), (9, [1e9] * 4, 0)]
    rows += [(200, [0.5, 0.5, 0.5, 0.5], 2), (10, [1.0, 1.0], 1), (11, [], 0), (12, [1.0] * 7, 1)]  # an anchor of two contents, unlike lengths
    want = brute(rows)
    assert len(want) > 50
    assert got(spark, rows) == want


def test_large_components_stay_exact(spark):
    rows = [(i, [60000.0 + i / 256, -60000.0, 3.0], i % 2) for i in range(0, 300, 10)]
    assert got(spark, rows) == brute(rows)


def test_rounds_of_anchors_and_small_holds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(0, 1) for _ in range(8)], rng.randrange(4)) for i in range(600)]
    assert got(spark, rows, every=20, block=400) == got(spark, rows, every=20) == brute(rows, every=20)


def test_few_rows_and_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0], 1)]) == []
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 0)]
    assert got(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_query_like_its_sql(spark):
    import duckdb

    from loomspark.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(Q.oracle_sql()["op11_hard_negatives"]).fetchall()
    out = Q.queries()["op11_hard_negatives"](spark, sf)
    names = duckdb.sql(Q.oracle_sql()["op11_hard_negatives"]).columns
    assert sorted(want) == sorted(tuple(r) for r in out.select(*names).collect()) and len(want) > 20
    assert out.where(F.col("rank") > 5).count() == 0
