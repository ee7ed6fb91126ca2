"""Imports and reach over random graphs, and what is worked out once."""

import random

from pyspark.sql import functions as F

from loomspark.functions import parse
from loomspark.operators import graph


def test_reach_is_the_same_whatever_is_sent(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(12)}") for _ in range(60)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    roots = ["n1", "n2", "n29", "none"]
    want = set()
    for root in roots:
        seen, new, depth = {root}, {root}, 0
        while new and depth < 3:
            depth += 1
            new = {s for s, t in pairs if t in new} - seen
            seen |= new
            want |= {(root, x, depth) for x in new}
    targets = spark.createDataFrame([(x,) for x in roots], "id string")
    sent = []
    monkeypatch.setattr(graph, "_into", lambda e, a, n, f=graph._into: sent.append(n) or f(e, a, n))
    found = lambda: {tuple(r) for r in graph.dependents(edges, targets, 3).collect()}
    assert found() == want and sent and max(sent) <= 4 * 12  # nodes that nothing leads into are not looked for
    monkeypatch.setattr(graph, "SENT", 0)
    assert found() == want


def test_imports_go_to_the_least_other_file(spark):
    files = spark.createDataFrame([("b", "s"), ("a", "s"), ("a", "s"), ("c", "s"), ("x", "t"), (None, "u"), ("d", None)], "id string, stem string")
    imports = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s"), ("x", "t"), ("q", "t"), ("q", "u"), ("q", None)], "source string, stem string")
    got = graph.resolved(imports, files)
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "a"), ("q", "x")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Join") == 1  # files are read once
    ends = graph.degrees(files.select("id"), got)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in ends  # and so are edges


def test_stems(spark):
    want = {"a.b.C": "c", "crate::x::Y": "y", "../lib/Part_1.js": "part_1", "a.": "", "": "", "..": "", "./x.y.js": "x", "a/b\\C.d": "c", "...a/b": "b", ".hidden/.x": "", "a/": "", "a\\b.c": "c"}
    rows = spark.createDataFrame([(x,) for x in want], "m string").select("m", parse.stem(F.col("m")).alias("s")).collect()
    assert {r["m"]: r["s"] for r in rows} == want
