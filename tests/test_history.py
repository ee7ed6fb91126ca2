"""Blame and listings of trees, against plain Python."""

import random

import pytest

from loomspark.operators import history

A, B, C = "a" * 40, "b" * 40, "c" * 40
ONE = f"{A} 1 1 2\nauthor Ann\nauthor-time 0\nsummary author Bob\nfilename x\n\tfirst\n{A} 2 2\n\t{B} 3 3\n{B} 1 3 1\nauthor \nauthor-time soon\n\t\n{A} 9 4 1\n\t\tauthor Eve"
TWO = f"{A} 7 1 1\n\tother file\r\n{C} 1 2 1\n\tnot told"


def test_details_are_filled_over_lines_and_files(spark):
    docs = spark.createDataFrame([("one", ONE, "x"), ("two", TWO, "x"), ("none", None, "x"), ("empty", "", "x")], "path string, text string, author string")
    got = sorted(map(tuple, history.blamed(docs, "path").collect()))
    ann = lambda path, n, line: (path, n, A, A[:7], "Ann", "1970-01-01", line)
    assert got == [
        ann("one", 1, "first"),
        ann("one", 2, f"{B} 3 3"),
        ("one", 3, B, B[:7], "", "", ""),
        ann("one", 4, "\tauthor Eve"),
        ann("two", 1, "other file\r"),
        ("two", 2, C, C[:7], "", "", "not told"),
    ]
    assert history.blamed(docs.limit(0), "path").count() == 0


def test_long_file_of_one_commit(spark):
    n = 200_000
    text = f"{A} 1 1 {n}\nauthor Ann\nauthor-time 86400\n" + "".join(f"{f'{A} {i} {i}' + chr(10) if i > 1 else ''}\tline {i}\n" for i in range(1, n + 1))
    rows = history.blamed(spark.createDataFrame([(text,)], "text string"))
    assert rows.where(f"author = 'Ann' AND date = '1970-01-02' AND content = concat('line ', line_no)").count() == n


def test_listing(spark):
    lines = [f"100644 blob {A}      12\tsrc/a b.py", f"160000 commit {B}       -\tlib", "fatal: not a tree", "", None]
    got = history.listed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(map(tuple, got)) == [("100644", "blob", A, 12, "src/a b.py"), ("160000", "commit", B, None, "lib")]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_against_plain_python(spark, seed):
    rng = random.Random(seed)
    some = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    tree, asked = sorted({some() for _ in range(12)}), [some() for _ in range(60)] + [None, "", "zzz"]

    def meant(rel):
        if rel is None or rel in tree:
            return rel
        ends = [t for t in tree if t.endswith("/" + rel)] or [t for t in tree if t.split("/")[-1] == rel.split("/")[-1]]
        return min(ends, key=lambda t: (len(t), t), default=None)

    rows = spark.createDataFrame([(i, r, "x") for i, r in enumerate(asked)], "i long, rel string, path string")
    got = {r["i"]: r["resolved"] for r in history.resolved(rows, spark.createDataFrame([(t,) for t in tree * 2], "path string")).collect()}
    assert got == {i: meant(r) for i, r in enumerate(asked)}
