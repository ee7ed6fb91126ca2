"""Near duplicates against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import neardup
from tests.llm import nasty


def units(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return Counter(grams)


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    sets = [units(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and jaccard(sets[i], sets[j]) >= 0.8)
            if same:
                head[max(find(i), find(j))] = min(find(i), find(j))
    of = [find(i) for i in range(len(rows))]
    ids = {g: min((rows[i][0] for i in range(len(rows)) if of[i] == g and rows[i][0] is not None), default=None) for g in set(of)}
    return Counter((rows[i][0], ids[of[i]], of.count(of[i])) for i in range(len(rows)))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    out, n = [], 100
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([4, 8, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((n, " ".join(text)))
            n += 1
    base = rng.choices(words, k=60)
    for _ in range(25):  # copies of one text, many of them too far from it and from each other
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((n := n + 1, " ".join(text)))
    chain = rng.choices(words, k=400)
    for _ in range(12):  # each close to the one before, the ends far apart
        chain = [*chain[8:], *rng.choices(words, k=8)]
        out.append((n := n + 1, " ".join(chain)))
    return out


def test_cells_give_exact_similarity():
    texts = [nasty.TEXTS[i] or "" for i in range(len(nasty.TEXTS))] + ["a b c d e f a b c d e f a b c d e", "A, b; c d E f"]
    got = neardup.similarity(texts * len(texts), [t for t in texts for _ in texts])
    want = [jaccard(units(a), units(b)) for b in texts for a in texts]
    assert np.allclose(got, want)


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = random.Random(3)
    w = [f"q{i}" for i in range(600)]
    errors = []
    for _ in range(30):
        a = rng.choices(w, k=300) * rng.choice([1, 2])
        b = list(a)
        for _ in range(6):
            b[rng.randrange(len(b))] = "new"
        units_, of, _ = neardup.cells([" ".join(a), " ".join(b)])
        best, _ = neardup.signatures(units_, of, 2)
        errors.append((best[0] == best[1]).mean() - jaccard(units(" ".join(a)), units(" ".join(b))))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


@pytest.mark.parametrize("sizes", [(2_000, 4_000_000, 500_000), (5, 400, 500_000), (2_000, 4_000_000, 0)])
def test_classes_match_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "UNITS", "BROADCAST_DOCS"), sizes, strict=True):
        monkeypatch.setattr(neardup, name, size)
    rows = [r[:2] for r in nasty.rows()] + corpus()
    full = [(*r, *[None] * 8) for r in rows]
    docs = spark.createDataFrame(full, nasty.SCHEMA).repartition(3)
    got = neardup.classes(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == brute(rows)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = {c for _, c, _ in brute(rows)}
    assert set(ids) == want and max(ids[i] for i in ids if i != 17) == 1


def test_rows_that_ask_meet_all_others_of_their_group_exactly():
    """Two groups in one task; a row outside meets all, by exact similarity, and names one of each component that is near."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(100)]
    texts = {1: words, 2: [*words[:90], *"abcdefghij"], 3: [*words[:93], *"tuvwxyz"], 4: words[:40], 5: [*words[:90], *"abcdefghix"]}
    rows = []
    for g, members in ((1, (1, 2, 3, 4, 5)), (9, (1, 4))):
        for c in members:
            units_, _, _ = neardup.cells([" ".join(texts[c])])
            for asks in (True, False):
                rows.append((g, c, 2 if c == 5 else c, len(units_), asks, np.sort(units_).tobytes()))
    table = pa.Table.from_pylist([dict(zip(("g", "c", "comp", "w", "asks", "units"), r, strict=True)) for r in rows])
    got = {tuple(r.values()) for r in neardup._compared(table, 0.8).to_pylist()}
    near = {(a, b) for a in texts for b in texts if a != b and jaccard(units(" ".join(texts[a])), units(" ".join(texts[b]))) >= 0.8}
    comp = lambda c: 2 if c == 5 else c
    assert {(a, comp(b)) for a, b in got} == {(a, comp(b)) for a, b in near if comp(a) != comp(b)} and got <= near


def test_empty(spark):
    assert neardup.classes(nasty.empty(spark)).count() == 0
    assert neardup.deduplicated(nasty.empty(spark)).count() == 0
