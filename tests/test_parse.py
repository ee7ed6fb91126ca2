"""Records inside texts, on literal rows."""

from pyspark.sql import functions as F

from loomspark.functions import parse as P


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_imports_and_stems(spark):
    assert one(spark, "import os\nfrom .auth import verify\nfrom a.b import c\nx = 1", lambda t: P.imported(t, "py")) == [".auth", "a.b", "os"]
    assert one(spark, "import x from './utils/helpers.ts';\nconst y = require('z')", lambda t: P.imported(t, "js")) == ["./utils/helpers.ts", "z"]
    assert one(spark, "use crate::net;\nmod util;", lambda t: P.imported(t, "rs")) == ["crate::net", "util"]
    assert [one(spark, m, P.stem) for m in (".auth", "a.b.Conf", "./utils/helpers.ts")] == ["auth", "conf", "helpers"]


def test_manifests(spark):
    got = one(spark, "django==4.2.7\nrequests>=2.0  # comment\n# bare\nflask\n", P.requirements)
    assert [tuple(r) for r in got] == [("django", "4.2.7"), ("requests", None), ("flask", None)]
    got = one(spark, '{"dependencies": {"a": "^1.2.3", "b": "*"}, "devDependencies": {"c": "4.5.6"}}', P.package_json)
    assert [tuple(r) for r in got] == [("a", "1.2.3"), ("b", None), ("c", "4.5.6")]
    assert one(spark, "broken", P.package_json) == []


def test_claims_and_markers(spark):
    got = one(spark, "see a/b.py:3-9 and c.py:4, **Lines 7-8** in `d.py`; version 3 in e.py", P.claims)
    assert [tuple(r) for r in got] == [("a/b.py", 3, 9), ("c.py", 4, 4), ("d.py", 7, 8)]
    assert one(spark, "a<think>b\nc</think>d</think>e<think>f", P.without_thoughts) == "ade<think>f"
    assert [tuple(r) for r in one(spark, 'x__STATUS__{"a":1}__STATUS_END__y', P.markers)] == [("STATUS", '{"a":1}')]
    assert [tuple(r) for r in one(spark, "FILE: a.py \nbody\nEND FILE\nFILE: b\nEND FILE", P.sections)] == [("a.py", "body\n"), ("b", "")]
    df = spark.createDataFrame([("f", 3, 9), ("f", 3, 3), ("f", None, None)], "n string, a int, b int")
    assert [r[0] for r in df.select(P.cited_as(F.col("n"), F.col("a"), F.col("b"))).collect()] == ["f:3-9", "f:3", "f"]
