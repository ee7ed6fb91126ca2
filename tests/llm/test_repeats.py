"""Substring dedup against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import repeats
from loomspark.llm.names import Runs, Sieve, Words
from tests.llm import nasty


def brute(rows, span=13):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, cut, strict=True):
        for p in range(len(w) - span + 1 if i is not None else 0):
            key = tuple(w[p : p + span])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, cut, strict=True):
        gone = {p + k for p in range(len(w) - span + 1 if i is not None else 0) if least[tuple(w[p : p + span])] < i for k in range(span)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return Counter(out)


def got(docs, span=13):
    return Counter(tuple(r) for r in repeats.without_repeats(docs, span).select("doc_id", "n_words", "n_removed", "kept").collect())


def corpus(seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(300)] + ["é", "Ünï", "\x00z", "a\x1cb"]
    passages = [[rng.choice(voc) for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    runs = [["x"] * 40, ["x", "y"] * 30, ["x"] * 20 + ["q"] + ["x"] * 20]
    out = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice([rng.choice(passages), rng.choice(runs), [rng.choice(voc) for _ in range(rng.randrange(40))], [rng.choice(voc)]])
        out.append((rng.choice([i, i, i, 5, None]), rng.choice([" ", "\n", " \t "]).join(words)))
    return out + out[:3]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_plain_python(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 3:
        monkeypatch.setattr(repeats, "HELD", 20)
        monkeypatch.setattr(repeats, "BROADCAST", 0)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h long").repartition(4)
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert got(docs) == want


def test_nasty_and_empty(spark):
    rows = [(r[0], r[1]) for r in nasty.rows()]
    assert got(nasty.documents(spark)) == brute(rows)
    assert got(nasty.empty(spark)) == Counter()


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_equal_windows_have_equal_signs(rounds):
    """Whatever stands around a window, its sign is the same; and windows of unlike words don't share all signs."""
    rng = random.Random(rounds)
    for voc in (2, 3, 50):
        window = [rng.randrange(voc) for _ in range(13)]
        found = set()
        for _ in range(60):
            around = [[str(rng.randrange(voc)) for _ in range(rng.randrange(30))] for _ in range(2)]
            words = Words([b"other text", " ".join([*around[0], *map(str, window), *around[1]]).encode()], repeats._INSIDE)
            starts, names = repeats.signs(words, 13, rounds)
            found.add(int(names[starts == 2 + len(around[0])][0]))
        assert len(found) == 1


def test_names_of_runs_and_sieve():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 5, 200).astype(np.uint64)
    runs = Runs(symbols, 2)
    start = rng.integers(0, 190, 500)
    end = start + rng.integers(1, 8, 500)
    for lane in (0, 1):
        names = {}
        for s, e, n in zip(start, end, runs.names(start, end, lane).tolist(), strict=True):
            names.setdefault(tuple(symbols[s:e].tolist()), set()).add(n)
        assert all(len(x) == 1 for x in names.values()) and len({n for x in names.values() for n in x}) == len(names)
    some = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    share, size = 3, 24
    parts = {b: Sieve.segment(some[(some >> np.uint64(61)) == b], size, share) for b in range(8)}
    sieve = Sieve.joined(parts, size, share)
    assert sieve.holds(some).all() and sieve.holds(rng.integers(0, 2**63, 3000).astype(np.uint64)).mean() < 0.01


def test_query_like_its_sql(spark):
    import duckdb

    from loomspark.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = duckdb.sql(Q.oracle_sql()["op12_substring_dedup"])
    out = Q.queries()["op12_substring_dedup"](spark, sf).select(*want.columns).collect()
    assert sorted(tuple(r) for r in out) == sorted(want.fetchall()) and sum(r["n_removed"] > 0 for r in out) > 20
