"""Few rows against many: what is named stays where it lies, documents that hold all tokens of a text, scores in a matrix."""

import numpy as np
from pyspark.sql import functions as F

from loomspark.functions.text import code_tokens
from loomspark.operators import lexical, lookup
from loomspark.plans import review, spans


def test_documents_that_hold_all_tokens(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 13}x" for j in range(1, 2 + i % 5))) for i in range(40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = ["w0x", "w1x w2x", "w3x w6x w9x", "w5x unknown", "?!", None, "w2x", "w4x w8x w12x w3x"]
    asked = spark.createDataFrame([(x,) for x in texts], "p string")
    index = lexical.Index.of(docs)
    have = {i: set((x or "").split()) for i, x in rows}
    want = sorted((i, x) for x in texts if x for i in have if {t for t in x.split() if t != "?!"} <= have[i])
    found = lambda: sorted(map(tuple, lexical.holding(index, asked, "p").select("doc_id", "p").collect()))
    assert found() == want and ("?!" in {x for _, x in want})
    monkeypatch.setattr(lexical, "CELLS", 30)
    assert found() == want
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert found() == want
    assert sorted(map(tuple, lexical.holding(index, asked, "p", F.slice(code_tokens(F.col("p")), 1, 1)).where("p = 'w1x w2x'").select("doc_id").collect())) == sorted((i,) for i in have if "w1x" in have[i])


def test_passages_without_tokens_have_answers_too(spark):
    docs = spark.createDataFrame([(1, "say ?! now"), (2, "say now"), (3, "?!")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "?!"), (8, "say  now"), (9, "now say")], "item_id long, text string")
    got = sorted(map(tuple, review.answers(lexical.Index.of(docs), docs, items).collect()))
    assert got == [(7, 1), (7, 3), (8, 2)]


def test_named_rows_either_way(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 5, i) for i in range(20)] + [(None, 99)], "k long, v long")
    few = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long")
    got = lambda: sorted(r["v"] for r in lookup.named(rows, few, "k").collect())
    want = sorted(i for i in range(20) if i % 5 in (1, 3))
    assert got() == want
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    assert got() == want


def test_high_scores_of_a_matrix_keep_all_ties():
    rng = np.random.default_rng(3)
    scores, group = rng.integers(-1, 5, (30, 7)).astype(float), rng.integers(0, 3, 30)
    for k in (None, 1, 4, 50):
        kept = set(lexical._high(scores, group, k).tolist())
        for q in range(7):
            for g in range(3):
                own = [(scores[i, q], i * 7 + q) for i in range(30) if group[i] == g and scores[i, q] > 0]
                edge = sorted((s for s, _ in own), reverse=True)[: k or len(own)][-1:] or [0]
                assert {c for s, c in own if s >= edge[0]} == {c for s, c in own if c in kept}


def test_true_spans_may_begin_within_words(spark, tmp_path):
    spark.createDataFrame([(1, "hello worlds and hello worlds"), (2, "hello there"), (3, "?! hello")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "llo worlds an"), (8, "?!"), (9, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    true = spans._retrieved(spark, str(tmp_path))[2]
    assert sorted(map(tuple, true.select("q", "file", "start", "stop").collect())) == [(7, 1, 2, 15), (8, 3, 0, 2)]
