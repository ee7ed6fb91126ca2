"""Sharding: the law, the slots, and how many links are cut."""

from collections import Counter, defaultdict
from zlib import crc32

from loomspark.llm import sharding
from tests.llm import nasty


def law(rows, docs, shards):
    want = Counter((i, len((t or "").encode()) + 8, crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def cut(rows):
    groups = defaultdict(Counter)
    for r in rows:
        groups[r["text_crc32"], r["size"]][r["shard"]] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values()), sum(sum(c.values()) for c in groups.values() if sum(c.values()) > 1)


def test_rows_law_on_trouble(spark):
    docs = [r[:2] for r in nasty.rows()]
    law(sharding.balanced(nasty.documents(spark)).collect(), docs, 24)
    assert sharding.balanced(nasty.empty(spark)).count() == 0


def test_links_stay_together(spark):
    docs = [(i, f"text {i % 700}" if i < 2100 else f"own {i}") for i in range(6000)] + [(9000 + i, "hot") for i in range(3000)]
    rows = sharding.balanced(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    law(rows, docs, 24)
    small = [r for r in rows if r["doc_id"] < 9000]
    lost, linked = cut(small)
    assert linked == 2100 and lost < 0.2 * linked
    of_hot = sorted(Counter(r["shard"] for r in rows if r["doc_id"] >= 9000).values())
    assert sum(of_hot[-12:]) > 0.6 * 3000  # a third of all rows needs eight shards at least


def test_groups_that_fit_a_shard_stay_whole(spark):
    sizes = {"hot": 800, "a": 90, "b": 70, "c": 40}  # shards of 100
    docs = [(i, t) for i, t in enumerate(t for t, n in sizes.items() for _ in range(n))]
    docs += [(i, f"own {i}") for i in range(len(docs), 2400)]
    rows = sharding.balanced(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    law(rows, docs, 24)
    by = {t: sorted(Counter(r["shard"] for r in rows if docs[r["doc_id"]][1] == t).values()) for t in sizes}
    assert [by[t] for t in "abc"] == [[90], [70], [40]]
    assert sum(by["hot"][-8:]) > 0.9 * 800


def test_shards_do_not_depend_on_files_and_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 7)
    docs = [(i, f"text {i % 300}") for i in range(900)] + [(5, "again")] * 200 + [(None, None)] * 100
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, other = (Counter(map(tuple, sharding.balanced(x).select("doc_id", "text_crc32", "shard", "slot").collect())) for x in (df.repartition(2), df.repartition(7)))
    assert one == other
    law(sharding.balanced(df).collect(), docs, 24)
