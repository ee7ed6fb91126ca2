"""Tokens cut in batches are those of the expression, whatever the texts."""

import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from loomspark.functions import tokens
from loomspark.functions.text import code_tokens
from loomspark.operators import lexical

ODD = [None, "", " ", "a", "aB", "9", "12ab", "XMLHttpRequest2 getURLFor", "9lives 99Red7Balloons", "snake_case_ID", "é1b ßaB naïveBayes 中文ab", "aBcDeF ABCdEF", "x" * 5000, "A" * 300 + "b", "İI", "\0a1\0", "end", "beginsNow"]


def test_token_sets_are_those_of_the_expression(spark, monkeypatch):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("abcXYZ019 _-.é\n") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows.select("id", F.array_sort(tokens.token_sets(F.col("text"))).alias("a"), F.array_sort(code_tokens(F.col("text"))).alias("b")).collect()
    assert [r["id"] for r in got if r["a"] != r["b"]] == []
    whole = [sorted(x) for x in tokens._cut_all(pa.array(texts)).to_pylist()]
    monkeypatch.setattr(tokens, "STRETCH", 50)  # in many stretches, and from the middle of an array
    assert [sorted(x) for x in tokens._cut_all(pa.array(["zz", *texts]).slice(1)).to_pylist()] == whole == [r["b"] for r in got]
    assert tokens._cut_all(pa.array([], pa.string())).to_pylist() == []


def test_tokens_are_counted_where_texts_are_cut(spark, monkeypatch):
    """One pass: rows keep their columns and tokens, and the counts of all stretches add up to the documents that have each token."""
    monkeypatch.setattr(tokens, "STRETCH", 50)
    texts = [*ODD, "aB aB", "endbegins", "beginsNow"]
    rows = spark.createDataFrame([(i, f"s{i % 3}" if i % 4 else None, t) for i, t in enumerate(texts)], "id int, source string, text string").repartition(3)
    got = tokens.counted(rows, "text").collect()
    want = {r["id"]: (r["source"], sorted(r["b"])) for r in rows.select("id", "source", code_tokens(F.col("text")).alias("b")).collect()}
    assert sorted((r["id"], r["source"], sorted(r["tokens"])) for r in got if r["many"] is None) == sorted((i, *x) for i, x in want.items())
    total = Counter()
    for r in got:
        if r["many"] is not None:
            assert r["id"] is None and r["source"] is None
            total.update(dict(zip(r["tokens"], r["many"], strict=True)))
    assert total == Counter(t for _, held in want.values() for t in held)


def test_index_counts_no_token_of_a_text_again(spark):
    """The documents that have a token are added up over stretches; the weights are those of the tokens of all texts."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}x" for j in range(4))) for i in range(40)] + [(90, None), (None, "w1x")], "doc_id long, text string")
    index = lexical.Index.of(docs)
    df = Counter(t for r in docs.select(code_tokens(F.col("text")).alias("b")).collect() for t in r["b"])
    raw = {t: math.log(42 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    want = {t: round(x if x >= 0 else lexical.EPSILON * sum(raw.values()) / len(raw), 9) for t, x in raw.items()}
    assert {r["token"]: round(r["idf"], 9) for r in index.weights.collect()} == want and index.n == 42
