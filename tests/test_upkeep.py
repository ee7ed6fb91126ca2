"""A stored index that follows its documents, against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import compare, graph, lexical, upkeep

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def texts(rng, n):
    voc = [f"word{i}" for i in range(60)] + ["camelCase", "HTTPServer", "x1"]
    return {i: (" ".join(rng.choice(voc) for _ in range(rng.randrange(25))) if i % 17 else None) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in rows.items()], DOCS).repartition(3)


def found(index, asked):
    return sorted(tuple(r) for r in lexical.search(index, asked, 7).select("item_id", "doc_id", "score", "rank").collect())


def test_follows_documents(spark, tmp_path):
    rng = random.Random(6)
    rows, folder = texts(rng, 60), str(tmp_path / "index")
    asked = spark.createDataFrame([(i, f"word{i} word{i + 7} camel server x1") for i in range(8)], "item_id long, text string")
    version = upkeep.start(frame(spark, rows), folder, carry=("source",))
    for change in range(3):
        rows = dict(rows)
        for i in rng.sample(sorted(rows), 6):
            rows[i] = " ".join(f"word{rng.randrange(60)}" for _ in range(8))
        for i in rng.sample(sorted(rows), 4):
            del rows[i]
        rows |= {100 * (change + 1) + i: t for i, t in texts(rng, 5).items()}
        if change == 1:
            rows[3] = "only here zebra"  # one that went may come back
        docs = frame(spark, rows)
        version = upkeep.advance(docs, folder, version, carry=("source",))
        assert not upkeep.plan(docs, folder, version).count()
        new = lexical.Index.of(docs, carry=("source",))
        kept = upkeep.index(spark, folder, version)
        assert found(kept, asked) == found(new, asked) and found(new, asked)
        assert {r["token"]: round(r["idf"], 9) for r in kept.weights.collect()} == {r["token"]: round(r["idf"], 9) for r in new.weights.collect()}
    cut = spark.read.parquet(f"{folder}/tokens/version={version}").count()
    assert cut < 20  # only what changed was cut again
    other = str(tmp_path / "whole")
    upkeep.compacted(spark, folder, version, other)
    assert found(upkeep.index(spark, other, 0), asked) == found(new, asked)


def test_nothing_changed_and_all_gone(spark, tmp_path):
    rows, folder = texts(random.Random(1), 10), str(tmp_path / "index")
    docs = frame(spark, rows)
    version = upkeep.advance(docs, folder, upkeep.start(docs, folder))
    assert spark.read.parquet(f"{folder}/tokens/version={version}").count() == 0
    version = upkeep.advance(docs.where("false"), folder, version)
    asked = spark.createDataFrame([(1, "word1 word2")], "item_id long, text string")
    assert found(upkeep.index(spark, folder, version), asked) == []


@pytest.mark.parametrize("within", [None, "source"])
def test_scores_beside_the_corpus_are_those_of_blocks(spark, monkeypatch, within):
    rng = random.Random(8)
    docs = frame(spark, texts(rng, 80))
    asked = spark.createDataFrame([(i, t) for i, t in texts(rng, 12).items()], "item_id long, text string")
    index = lexical.Index.of(docs, carry=("source",))
    got = sorted(tuple(r) for r in lexical.search(index, asked, 5, within=within).collect())
    monkeypatch.setattr(lexical, "PAIRS", 50)
    assert sorted(tuple(r) for r in lexical.search(index, asked, 5, within=within).collect()) == got
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", -1)
    assert sorted(tuple(r) for r in lexical.search(index, asked, 5, within=within).collect()) == got and got
    all_ = sorted(tuple(r) for r in lexical.scored(index, asked).select("item_id", "doc_id", "score").collect())
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 1 << 20)
    assert sorted(tuple(r) for r in lexical.scored(index, asked).select("item_id", "doc_id", "score").collect()) == all_


def test_keys_that_come_twice_go_by_blocks(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "s"), (1, "alpha gamma", "s"), (2, "alpha", "s"), (3, "delta", "s"), (4, "delta", "s"), (5, "eps", "s")], DOCS)
    index = lexical.Index.of(docs)
    assert not index.single()
    asked = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.search(index, asked, 5).collect()] == [1]


def test_imports_of_one_stem(spark):
    """The least file of the stem that isn't the importer itself, however many files share it."""
    n = 3000
    files = spark.createDataFrame([(f"d{i:05}/index.js", "index") for i in range(n)] + [("only.js", "only")], "id string, stem string")
    imports = files.where("stem = 'index'").select(F.col("id").alias("source"), F.lit("index").alias("stem")).union(files.where("stem = 'only'").select("id", F.lit("only")))
    got = {r["source"]: r["target"] for r in graph.resolved(imports, files).collect()}
    assert got == {f"d{i:05}/index.js": "d00000/index.js" if i else "d00001/index.js" for i in range(n)}


def test_embedding_keeps_the_order_of_the_text(spark):
    """Of too many tokens the last ones are left out, whatever letters they begin with."""
    rows = spark.createDataFrame([(1, ["zz", "yy", "aa"]), (2, ["zz", "yy"])], "id int, t array<string>")
    got = {}
    for r in compare.hash_embedding(rows, "id", F.col("t"), most=2).collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["weight"]
        assert r["dropped"] == (1 if r["id"] == 1 else 0)
    assert got[1] == got[2]


def test_embedding_has_all_words_of_a_turn(spark, tmp_path):
    """Words beyond the fortieth count: turns that differ in their last word alone differ, and nothing is told as dropped."""
    from loomspark.plans.more import hash_embedding

    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1, 0, f"{words} alpha"), (2, 0, f"{words} beta"), (3, 0, f"{words} ALPHA"), (4, 0, None), (5, 0, "")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in hash_embedding(spark, str(tmp_path)).collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["weight"]
        assert r["dropped"] == 0
    assert got[1000] == got[3000] != got[2000] and set(got) == {1000, 2000, 3000}
