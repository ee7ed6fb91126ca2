"""Bounded events, encodings, the feed and the SQL tools against plain Python on hard small rows."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspark.functions import bounds, encodings
from loomspark.operators import feed, sqltools
from loomspark.plans import surface
from tests.conftest import SF

SCHEMA = "id int, step string, message string, tool string, plan_id string, n int, ok boolean, items array<string>, deep map<string,array<map<string,string>>>, rec struct<a:string,b:array<int>>, extra map<string,string>"


def shrunk(value, most=bounds.FIELD):
    if isinstance(value, str):
        return value if len(value) <= most else value[: most - 1] + "…"
    if isinstance(value, list):
        return [shrunk(x) for x in value[: bounds.LIST]]
    if isinstance(value, dict):
        return {k: shrunk(x) for k, x in list(value.items())[: bounds.INNER]}
    return value


def expected(payload, extra):
    """The event and its passes by plain Python."""
    e = {k: shrunk(v, bounds.MESSAGE if k == "message" else bounds.FIELD) for k, v in payload.items() if v is not None}
    e |= {k: shrunk(v) for k, v in (extra or {}).items() if k not in payload}
    if len(e) > bounds.FIELDS:
        kept = {k: v for k, v in e.items() if k in bounds.KEPT}
        more = len(e) - bounds.FIELDS
        e = kept | dict(list(e.items())[: bounds.FIELDS - len(kept)]) | {"fields_dropped": more}
    kept = {k: v for k, v in e.items() if k in bounds.KEPT}
    passes = [e, {k: v for k, v in e.items() if not isinstance(v, list)}]
    passes += [{k: shrunk(v, n) for k, v in kept.items()} for n in (bounds.FIELD, bounds.SHORTEST)]
    for n, p in enumerate(passes, 1):
        text = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False, separators=(',', ':'))}" for k, v in p.items()) + "}"
        for mark in bounds.MARKS:
            text = text.replace(f"__{mark}__", f"\\u005f_{mark}__")
        if len(text.encode()) <= bounds.BYTES:
            return n, text, p
    raise AssertionError("the last pass always fits")


HARD = [
    {"step": "a"},
    {"step": None, "message": "x" * 420, "tool": "", "items": []},
    {"message": "é" * 421, "tool": "t" * 180, "n": 3, "ok": False},
    {"message": "ends __STATUS_END__ and __STATUS__STATUS_END__ _", "tool": "q\"\\\n\t"},
    {"step": "s", "items": ["i" * 300] * 13, "deep": {f"k{i}": [{f"m{j}": "v" * 200 for j in range(17)}] for i in range(2)}},
    {"step": "s", "items": ["w" * 180] * 30, "extra": {f"x{i}": "y" * 140 for i in range(18)}},
    {"step": "s" * 999, "message": "\U0001f600" * 500, "extra": {f"x{i}": "y" * 300 for i in range(40)}},
    {"step": "\x01" * 400, "message": "\x02" * 900, "tool": "\x03" * 400, "plan_id": "\x01" * 400, "extra": {"step_id": "\x01" * 400}},
    {"step": "s", "extra": {"n": "column wins", "z": "1"}, "n": 5, "rec": Row(a="a" * 200, b=list(range(20)))},
    {"step": "s", "extra": {f"x{i}": str(i) for i in range(24)}, "plan_id": "p"},
]


def hard_rows(spark):
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")][1:]
    return spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(HARD)], SCHEMA)


def fields_of(rows):
    return {f.name: (F.col(f.name), f.dataType) for f in rows.schema if f.name not in ("id", "extra")}


def plain(value):
    return value.asDict(recursive=True) if isinstance(value, Row) else value


def test_events_are_bounded_as_in_plain_python(spark):
    rows = hard_rows(spark)
    got = {r["id"]: r["t"] for r in rows.select("id", bounds.encoded(fields_of(rows), F.col("extra")).alias("t")).collect()}
    told = set()
    entries = lambda c: F.map_entries(c).alias(c)  # noqa: E731  (a collected map has another order than the column)
    inner = F.transform(F.map_entries("deep"), lambda e: F.struct(e["key"], F.transform(e["value"], lambda m: F.map_entries(m)))).alias("deep")
    for r in rows.select("*", inner, entries("extra")).toDF(*rows.columns, "deep_entries", "extra_entries").collect():
        payload = {n: plain(r[n]) for n in fields_of(rows)}
        if payload["deep"]:
            payload["deep"] = {k: [dict(map(tuple, m)) for m in v] for k, v in r["deep_entries"]}
        passes, text, parsed = expected(payload, dict(map(tuple, r["extra_entries"] or [])))
        event = got[r["id"]]["event"]
        assert got[r["id"]]["passes"] == passes and len(event.encode()) <= bounds.BYTES
        assert json.loads(event) == parsed and not any(f"__{m}__" in event for m in bounds.MARKS)
        if "\x01" not in text:  # escapes of control codes differ in the case of their digits alone
            assert event == text
        told.add(passes)
    assert told == {1, 2, 3, 4}


def test_events_beside_clashing_aliases(spark):
    rows = hard_rows(spark)
    alone = rows.select("id", bounds.encoded(fields_of(rows), F.col("extra")).alias("t"))
    beside = rows.select("id", F.lit("zz").alias("message"), F.lit("zz").alias("tool"), bounds.encoded(fields_of(rows), rows["extra"]).alias("t"))
    assert sorted(alone.collect()) == sorted(beside.select("id", "t").collect())
    assert rows.limit(0).select(bounds.encoded(fields_of(rows)).alias("t")).count() == 0


ENCODED = [
    ("plain", b"plain", "utf-8", "plain"), ("none", b"", "utf-8", ""), ("marked", "\ufeffé".encode(), "utf-8", "é"),
    ("le", "\ufeffab é\U0001f600".encode("utf-16le"), "utf-16le", "ab é\U0001f600"), ("be", "\ufeffab".encode("utf-16be"), "utf-16be", "ab"),
    ("bare le", "def f(): é\n".encode("utf-16le"), "utf-16le", "def f(): é\n"), ("bare be", "def f(): é\n".encode("utf-16be"), "utf-16be", "def f(): é\n"),
    ("latin", "für é".encode("latin-1"), "iso-8859-1", "für é"), ("windows", "“für” € –".encode("cp1252"), "windows-1252", "“für” € –"),
    ("undefined", b"\xe9\x81", "iso-8859-1", "é\x81"), ("binary", b"\x00\x01\xff\x00\xfe", "binary", None), ("zero", b"a\x00bcdefgh", "utf-8", "a\x00bcdefgh"),
    ("lone half", b"\xff\xfe\x00\xd8a\x00", "binary", None), ("odd", b"\xff\xfea\x00b", "binary", None), ("null", None, None, None),
    ("cut utf-8", "é".encode() + b"\xc3", "iso-8859-1", "Ã©Ã"), ("long", "ü".encode("latin-1") * 300_000, "iso-8859-1", "ü" * 300_000),
    ("long wide", "ab\n".encode("utf-16le") * 200_000, "utf-16le", "ab\n" * 200_000),
]


def test_encodings_are_told_from_bytes(spark):
    rows = spark.createDataFrame([(n, b) for n, b, _, _ in ENCODED], "name string, content binary")
    got = {r["name"]: r["d"] for r in rows.select("name", F.lit("zz").alias("bytes"), encodings.decoded(F.col("content")).alias("d")).collect()}
    for name, _, encoding, text in ENCODED:
        assert (got[name] and got[name]["encoding"], got[name] and got[name]["text"]) == (encoding, text), name


def test_feed_takes_times_of_three_kinds_and_filters_first(spark):
    empty = F.lit(None).cast("string")
    texts = spark.createDataFrame([(1, "2024-01-02T03:04:05", '{"n": 1}'), (2, "soon", "{"), (3, None, None), (4, "2024-01-02T03:04:05", "{broken")], "id int, at string, meta string")
    seconds = spark.createDataFrame([(i, float(i), (i,)) for i in range(300)], "id int, at double, meta struct<n:int>")
    a = feed.source(texts, "text", "id", "at", 50, F.lit("t" * 99), empty, empty, "meta")
    b = feed.source(seconds, "number", "id", "at", 500, empty, F.lit("d" * 999), empty, "meta")
    rows = feed.activity([b, a], 5).select("id", "ts", "title", F.to_json("meta").alias("m")).collect()
    assert [r["id"] for r in rows] == ["text-1", "text-4", "number-299", "number-298", "number-297"]
    assert rows[0]["m"] == '{"n":1}' and rows[1]["m"] is None and len(rows[0]["title"]) == 80
    assert str(rows[2]["ts"]) == "1970-01-01 00:04:59" and rows[2]["m"] == '{"n":299}'
    assert feed.activity([b, a], 1000).count() == feed.MOST and feed.activity([b, a], 0).count() == 1
    assert {r["kind"] for r in feed.activity([a, b], 5, " Number ").collect()} == {"number"}
    assert feed.activity([b.limit(0), a.limit(0)], 5).count() == 0


def test_tools_from_sql(spark):
    sqltools.registered(spark)
    code = "def a():\n    Eval(x)   \n\nclass B:\n  pub fn go(x)\nexport const f = async (\n# todo 42\n" + "e" * 121
    spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "eval\n" * 40)], "id int, body string").createOrReplaceTempView("tool_files")
    hits = spark.sql("SELECT id, line, shown FROM tool_files, LATERAL search_pattern(body, '\\\\beval\\\\b')").collect()
    assert [(r["line"], r["shown"]) for r in hits if r["id"] == 1] == [(2, "    Eval(x)")]
    assert [r["line"] for r in hits if r["id"] == 4] == list(range(1, 31)) and {r["id"] for r in hits} == {1, 4}
    found = spark.sql("SELECT id, line FROM tool_files, LATERAL function_list(body)").collect()
    assert [r["line"] for r in found] == [1, 4, 5, 6]
    counts = {r["id"]: tuple(r)[1:] for r in spark.sql("SELECT id, c.* FROM tool_files, LATERAL complexity_indicators(body) c").collect()}
    assert counts[1] == (8, 1, 1, 1) and counts[3] == (1, 0, 0, 0) and counts[2][1:] == (None, None, None)


@pytest.mark.parametrize("name", ["pattern_hits", "tool_counts", "bounded_events"])
def test_tools_leave_no_python_and_no_shuffle(spark, name):
    plan = surface.QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and (name == "tool_counts" or "Exchange" not in plan)
