"""Decontamination against brute force over every window."""

import re
from collections import Counter

import pytest

from loomspark.llm import decontam
from tests.llm import nasty


def folded(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        w = folded(text)
        if item_id is None or not w:
            continue
        for i in range(max(1, len(w) - size + 1)):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item_id))
    out = Counter()
    for doc_id, text in docs:
        w, hit, ids = folded(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= of
        out[(doc_id, len(w), len(hit), len(ids), ",".join(sorted(ids)))] += 1
    return out


ITEMS = [(1, "the same words again and again the same words again and again"), (2, "Short ITEM"), (10, "word"), (3, None), (4, "..."), (None, "word"),
         (5, " ".join(f"w{i}" for i in range(500, 540))), (6, "again and again the same words again and again the same extra tail"), (2, "Short ITEM"), (7, "É à Zürich")]


@pytest.mark.parametrize(("words", "size"), [(50_000, 64_000_000), (0, 64_000_000), (0, 0), (50_000, 0)])
def test_matches_brute_force(spark, monkeypatch, words, size):
    monkeypatch.setattr(decontam, "SET_SHINGLES", words)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", size)
    rows = [*nasty.rows(), (60, "here is a short, item: and w501 w502", *[None] * 8), (61, "x " + " ".join(f"W{i}" for i in range(495, 512)), *[None] * 8)]
    got = decontam.judged(spark.createDataFrame(rows, nasty.SCHEMA), spark.createDataFrame(ITEMS, "item_id int, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["item_ids"])) for r in got) == brute([r[:2] for r in rows], ITEMS)


def test_empty_tables_and_clean(spark):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = nasty.documents(spark)
    assert decontam.judged(nasty.empty(spark), items).count() == 0
    assert decontam.judged(docs, items.limit(0)).where("n_hit > 0").count() == 0
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    want = sum(n for k, n in brute([r[:2] for r in nasty.rows()], ITEMS).items() if k[2] == 0)
    assert kept.count() == want
