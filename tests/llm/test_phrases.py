"""Collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loomspark.llm import phrases
from tests.llm import nasty


def brute(rows, least=30, within=80, top=2000):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] >= within * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(docs, **how):
    return sorted(tuple(r) for r in phrases.collocations(docs, **how).collect())


def corpus(seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(25)] + ["É", "é", "W1", "x\x00y", "a-b"]
    fixed = [[rng.choice(voc) for _ in range(m)] for m in (2, 3, 4, 6, 9)]
    rows = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(30)):
            parts += rng.choice([rng.choice(fixed), [rng.choice(voc)], [rng.choice(voc), rng.choice([".", ",", "!\n", ":", "\x0c"])]])
        rows.append((rng.choice([" ", "\t", "  "]).join(parts), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_plain_python(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed == 3:
        monkeypatch.setattr(phrases, "HELD", 200)
        monkeypatch.setattr(phrases, "TOLD", 5)
    docs = spark.createDataFrame([(t, g, 7) for t, g in rows], "text string, lang string, w1 long").repartition(4)
    want = brute(rows)
    assert len(want) > 20
    assert got(docs) == want
    assert got(docs, least=3, within=50, top=15) == brute(rows, 3, 50, 15)


def test_nasty_and_empty(spark):
    rows = [(r[1], r[2]) for r in nasty.rows()]
    assert got(nasty.documents(spark)) == brute(rows)
    assert got(nasty.documents(spark), least=1, top=50) == brute(rows, 1, 80, 50)
    assert got(nasty.empty(spark)) == []


def test_unequal_edges_of_one_digest_stay_apart(monkeypatch):
    """Where digests meet, words tell edges apart."""
    import numpy as np

    monkeypatch.setattr(phrases, "_digest", lambda e: np.zeros(len(e), np.uint64))
    rows = np.zeros(6, phrases._EDGE)
    rows["w1"], rows["n"] = [1, 2, 1, 2, 2, 1], 1
    out = phrases._summed(rows)
    assert sorted(zip(out["w1"].tolist(), out["n"].tolist(), strict=True)) == [(1, 3), (2, 3)]


def test_query_like_its_sql(spark):
    import duckdb

    from loomspark.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = duckdb.sql(Q.oracle_sql()["op13_phrase_mining"])
    out = Q.queries()["op13_phrase_mining"](spark, sf).select(*want.columns).collect()
    assert sorted(tuple(r) for r in out) == sorted(want.fetchall()) and len(out) > 100
