"""Chunks by separators and metrics by spans, against plain Python and against their SQL."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark.functions import cascade
from loomspark.operators import spans
from loomspark.plans import spans as plans

SF = "/root/testdata/sf0.001"


def brute_chunks(text, size, overlap, separators):
    """Texts of chunks by recursion and merging, with the place of each part."""
    out = []

    def merge(parts):
        held, total = [], 0
        for at, part in parts:
            if total + len(part) > size and held:
                out.append((held[0][0], "".join(p for _, p in held)))
                while total > overlap or (total + len(part) > size and total > 0):
                    total -= len(held[0][1])
                    held = held[1:]
            held.append((at, part))
            total += len(part)
        if held:
            out.append((held[0][0], "".join(p for _, p in held)))

    def split(at, text, separators):
        own, rest = "", ()
        for i, s in enumerate(separators):
            if s in text:
                own, rest = s, separators[i + 1 :]
                break
        parts = list(text) if not own else [p for p in [text.split(own)[0], *[own + x for x in text.split(own)[1:]]] if p]
        good = []
        for part in parts:
            if len(part) < size:
                good.append((at, part))
            else:
                merge(good)
                good = []
                split(at, part, rest)
            at += len(part)
        merge(good)

    split(0, text, separators)
    told = []
    for at, raw in out:
        whole = raw.strip()
        if whole:
            start = at + len(raw) - len(raw.lstrip())
            told.append((start, start + len(whole), text.count("\n", 0, start) + 1, text.count("\n", 0, start + len(whole)) + 1, whole))
    return told


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n\n ", "x" * 100, "é🙂" * 40, "one\n\n\n\ntwo", "\n\na", "a b " * 50, "word " + "y" * 95 + " tail\n\n" + "z" * 31]
    for _ in range(60):
        out.append("".join(rng.choice(["\n\n", "\n", " ", " ", "a", "bb" * rng.randrange(1, 30), "É\t", "\nclass ", "q" * rng.randrange(50)]) for _ in range(rng.randrange(60))))
    return out


@pytest.mark.parametrize(("size", "overlap", "separators"), [(30, 10, cascade.SEPARATORS), (25, 0, cascade.SEPARATORS), (40, 15, ("\nclass ", *cascade.SEPARATORS))])
def test_chunks_like_plain_python(spark, size, overlap, separators):
    rows = texts(size)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    # An earlier alias of the text's own name must change nothing.
    got = {r["i"]: [tuple(c) for c in r["c"]] for r in df.select("i", F.lit("zz").alias("text"), cascade.chunks(df["text"], size, overlap, separators).alias("c")).collect()}
    for i, t in enumerate(rows):
        assert got[i] == brute_chunks(t or "", size, overlap, separators), repr(t)
        assert all(t[a:b] == c for a, b, _, _, c in got[i])


def test_chunks_of_a_long_text_take_linear_time(spark):
    line = "some words of a line that goes on for a while " * 3
    seconds = []
    for n in (1_000_000, 2_000_000):
        text = ((line + "\n") * 9 + "\n") * (n // 1260)
        df = spark.createDataFrame([(text,)], "text string").select(cascade.chunks(F.col("text")).alias("c"))
        df.select(F.size("c")).collect()
        began = time.time()
        rows = df.collect()[0]["c"]
        seconds.append(time.time() - began)
        assert len(rows) > n / 800 and all(text[r["start"] : r["stop"]] == r["text"] for r in rows[::50])
    assert seconds[1] < 3.5 * seconds[0] + 2


def brute_cover(rows):
    out = {}
    for g, side, a, b in rows:
        if b > a:
            out.setdefault(g, {"found": set(), "true": set()})[side] |= set(range(a, b))
    return sorted((g, len(x["found"]), len(x["true"]), len(x["found"] & x["true"])) for g, x in out.items())


def test_covered_like_sets(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.choice(["found", "true"]), a, a + rng.randrange(-1, 40)) for a in (rng.randrange(300) for _ in range(400))]
    rows += [(9, "found", 0, 500)] * 300 + [(9, "true", 100, 101)] + [(8, "true", 5, 5)]
    df = spark.createDataFrame(rows, "g int, side string, start int, stop int")
    for stretch in (7, 64, 65_536):
        assert sorted(tuple(r) for r in spans.covered(df, ["g"], stretch).collect()) == brute_cover(rows)


def test_localized_by_hand(spark):
    asked = spark.createDataFrame([(1, ["foo", "bar"]), (2, []), (3, ["baz"]), (4, None), (5, ["none"])], "q int, symbols array<string>")
    units = spark.createDataFrame(
        [("a", 1, 1, False, "foo here", "foo here"), ("a", 1, 2, True, "nothing", "bar too"), ("a", 1, 3, True, "a bar", "a bar"), ("a", 3, 9, True, "baz", "baz"), ("a", 2, 1, True, "x", "x"), ("b", 3, 1, True, "baz", "baz")],
        "leg string, q int, rank int, right boolean, text string, parent string",
    )
    got = {r["leg"]: tuple(r)[1:] for r in spans.localized(asked, units).collect()}
    assert got["a"] == (5, 3, 33.3333, round(1 / 9, 6), 33.3333, 50.0)
    assert got["b"] == (5, 3, 33.3333, round(1 / 3, 6), 100.0, 25.0)
    none = spans.localized(asked.where("q = 2"), units.where("q = 2")).collect()
    assert tuple(none[0]) == ("a", 1, 0, None, None, None, None)


def test_overlap_of_a_leg_that_finds_nothing(spark):
    found = spark.createDataFrame([("a", 1, 7, 0, 10), ("a", 1, 7, 5, 20)], "leg string, q int, file int, start int, stop int")
    true = spark.createDataFrame([(1, 7, 15, 25), (2, 7, 0, 5)], "q int, file int, start int, stop int")
    got = {r["leg"]: tuple(r)[1:] for r in spans.overlap(found, true, ["a", "b"]).collect()}
    assert got == {"a": (20, 15, 5, 33.3333, 25.0), "b": (0, 15, 0, 0.0, None)}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_like_its_sql(spark, name):
    query, sql = plans.QUERIES[name]
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    out = query(spark, SF)
    assert sorted(out.columns) == sorted(names)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
