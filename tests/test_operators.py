"""Operators on literal rows: ties, quirks and edges."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chat, compare, delta, dense, files, fusion, graph, lexical, logs, query, rules


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bm25_finds_identifiers(spark):
    docs = spark.createDataFrame([(1, "def authenticate_user(token): return jwt.decode(token)"), (2, "def get_db(): db = SessionLocal()"), (3, "JWT_SECRET_KEY = 'secret'")], "doc_id int, text string")
    ask = spark.createDataFrame([(1, "JWT_SECRET_KEY"), (2, "!!"), (3, None)], "item_id int, text string")
    got = lexical.ranked(lexical.bm25(docs, ask), "item_id", "doc_id", k=2).collect()
    assert got[0]["doc_id"] == 3 and {r["item_id"] for r in got} == {1}


@pytest.mark.parametrize("text,want", [("HTTPClient getUserName2x", {"httpclient", "http", "client", "getusername2x", "get", "user", "name2x"}), ("foo_bar 12ab a", {"foo", "bar", "ab", "12ab"}), ("", set()), (None, set())])
def test_code_tokens(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(T.code_tokens(F.col("t")).alias("x")).first()["x"]
    assert set(got) == want and len(got) == len(want)


def test_windows_cover_and_overlap(spark):
    df = spark.range(0, 3000, 37).select(F.col("id").alias("n"), T.window_spans(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("w"))
    for r in df.collect():
        w = [(x["start"], x["stop"]) for x in r["w"]]
        assert (not w) == (r["n"] == 0)
        if w:
            assert w[0][0] == 0 and w[-1][1] == r["n"] and all(b - a <= 900 for a, b in w) and all(a2 < b1 < b2 for (_, b1), (a2, b2) in zip(w, w[1:], strict=False))
            assert r["n"] > 900 or len(w) == 1


def test_ranges_round_trip(spark):
    df = spark.createDataFrame([([3, 1, 2, 7, 9, 10],), ([],), ([5, 5],)], "l array<int>").select(T.encoded_ranges(F.col("l")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["1-3,7,9-10", "", "5"]
    back = spark.createDataFrame([("1-3,x,7,9-10,5-4,0-2",), (None,)], "t string").select(T.decoded_ranges(F.col("t")).alias("r")).collect()
    assert [tuple(x) for x in back[0]["r"]] == [(1, 3), (7, 7), (9, 10)] and back[1]["r"] == []


def test_fusion_accumulates_and_limits(spark):
    a = spark.createDataFrame([(1, "auth", 1), (1, "db", 2)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "config", 1), (1, "auth", 2)], "q int, k string, rank int")
    assert lexical.ranked(fusion.reciprocal_ranks([a, b], "q", "k"), "q", "k", k=1).first()["k"] == "auth"
    d = spark.createDataFrame([(1, s, i) for i, s in enumerate("aaab")], "q int, s string, rank int")
    assert [r["s"] for r in fusion.diversified(d, "q", "s", 2, 3).orderBy("rank").collect()] == ["a", "a", "b"]


def test_question_analysis(spark):
    asked = ["@auth.py where is the JWT verified?", "show me the endpoint", "explain chunking", "@only.py"]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    rest, name = query.scope(F.col("q"))
    got = df.select(rest.alias("r"), name.alias("f"), query.intent(F.col("q")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("where is the JWT verified?", "auth.py", "security"), ("show me the endpoint", None, "api"), ("explain chunking", None, "general"), ("@only.py", "only.py", "general")]


def test_percentile_rules_differ(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 21)], "g string, v double")
    assert logs.endpoint_summary(df, "g", "v", F.lit(False)).first()["p95"] == 20.0
    assert logs.nearest_rank(df, "g", "v").first()["p95"] == 19.0


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 9, 3, 2])], "q int, o int, s long")
    assert files.fitted(df, "q", "o", "s", 10).first()["kept"] == "0,2,3"
    talk = spark.createDataFrame([(1, t, "user", "x" * n) for t, n in enumerate([40, 4000, 40, 40])], "conv_id int, turn int, role string, text string")
    got = chat.pruned(talk, 100).first()
    assert (got["n_before"], got["n_kept"], got["tokens_after"]) == (4, 3, 30)


def test_graph_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("app", "auth"), ("app", "db"), ("auth", "crypto"), ("crypto", "app")], "source string, target string")
    t = spark.createDataFrame([("crypto",), ("none",)], "id string")
    assert rows(graph.dependents(e, t), "id", "depth") == [("app", 2), ("auth", 1)]
    assert rows(graph.dependents(e, t, 1), "id") == [("auth",)]
    assert graph.dependents(e, t.where("id = 'none'")).count() == 0


def test_delta_actions(spark):
    cur = spark.createDataFrame([("same", "h"), ("changed", "h2"), ("new", "h"), ("mixed", "h"), ("old", "h"), ("unstamped", "h")], "source string, content_hash string")
    idx = spark.createDataFrame([("same", "h", "b"), ("changed", "h", "b"), ("gone", "h", "b"), ("mixed", "h", "b"), ("mixed", "x", "b"), ("old", "h", "a"), ("unstamped", "h", None)], "source string, content_hash string, index_build string")
    assert rows(delta.plan(cur, idx, "b"), "source", "action", "n_stale") == [("changed", "changed", 1), ("gone", "removed", 1), ("mixed", "changed", 2), ("new", "new", 0), ("old", "rebuilt", 1), ("same", "skipped", 0), ("unstamped", "rebuilt", 1)]


def test_diff_lines_are_numbered_as_in_the_new_file(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,4 @@\n keep\n+api_key = 'abcdef'\n-gone\n+eval(x)\n+print(1)\n--- a/db.py\n+++ b/db.py\n@@ -10,1 +10,2 @@\n keep\n+q = 'select ' + x"
    added = rules.added_lines(spark.createDataFrame([(1, diff)], "d int, diff string"), "d", "diff")
    assert rows(added, "path", "line") == [("a.py", 2), ("a.py", 3), ("a.py", 4), ("db.py", 11)]
    found = rules.line_findings(added.select((F.col("line") + F.when(F.col("path") == "db.py", 100).otherwise(0)).alias("k"), "body"), "k", "body")
    assert rows(found, "k", "rule") == [(2, "possible-secret"), (3, "eval-exec"), (4, "debug-print"), (111, "sql-concatenation")]


def test_policy_and_grounding(spark):
    df = spark.createDataFrame([(2, True, None, None), (6, True, None, "reviewed by two"), (6, True, "t", "reviewed by two"), (6, True, "t", "ok"), (10, True, "t", "reviewed by two"), (1, False, None, None)], "s int, v boolean, t string, r string")
    got = [r[0] for r in df.select(rules.decision(F.col("s"), F.col("v"), F.col("t"), F.col("r"))).collect()]
    assert got == ["allowed", "needs_approval", "allowed", "needs_approval", "blocked", "blocked"]
    served = spark.createDataFrame([("a", 10, 20), ("a", 40, 50)], "file string, low int, high int")
    claims = spark.createDataFrame([("a", 12, 90), ("a", 30, 31), ("b", 1, 2)], "file string, start int, end int")
    assert rows(rules.grounded(claims, served), "file", "start", "verdict") == [("a", 12, "matched"), ("a", 30, "outside_range"), ("b", 1, "not_in_context")]


def test_dense_skips_nulls_and_zero(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = dense.cosine_top(v, v.where("vec_id = 0"), 10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (5, 0.707107), (2, 0.0)]
    assert dense.cosine_top(v, v.limit(0)).count() == 0


def test_merged_drops_overlap(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300))
    parts = [text[0:400], text[350:700], text[650:]]
    assert spark.createDataFrame([(parts,)], "p array<string>").select(files.merged(F.col("p")).alias("m")).first()["m"] == text


def test_turn_changes_match_difflib(spark):
    import difflib

    pairs = [("a\nb\nc", "a\nx\nc\nd"), ("", "q"), (None, None), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", compare.similarity_ratio("a", "b").alias("r"), compare.line_changes("a", "b").alias("c"))
    for r in df.collect():
        a, b = r["a"] or "", r["b"] or ""
        assert r["r"] == difflib.SequenceMatcher(None, a, b).ratio()
        diff = list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=0))
        body = [x for x in diff[2:] if not x.startswith("@@")]
        assert (r["c"]["added"], r["c"]["removed"]) == (sum(x[0] == "+" for x in body), sum(x[0] == "-" for x in body))


def test_diverse_choice_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(12, 5))
    v[1] = v[0]
    score = np.linspace(1, 0.4, 12)
    df = spark.createDataFrame([(1, i, float(score[i]), v[i].tolist()) for i in range(12)], "query_id long, id long, score double, v array<double>")
    got = [r["id"] for r in compare.diverse(df, 5).orderBy("pick").collect()]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    picked = [0]
    while len(picked) < 5:
        gain = {i: 0.5 * score[i] - 0.5 * max(float(unit[i] @ unit[j]) for j in picked) for i in range(12) if i not in picked}
        picked.append(max(gain, key=gain.get))
    assert got == picked and 1 not in got[:2]


def test_stored_index_is_used_until_the_documents_change(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma delta"), (3, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "gamma alpha")], "item_id long, text string")
    index = lexical.Index.of(docs)
    index.write(str(tmp_path), docs)
    again = lexical.Index.read(str(tmp_path), docs.orderBy("text"))
    want = lexical.search(docs, ask, 5).collect()
    assert again is not None and lexical.search(again, ask, 5).collect() == want and {r["doc_id"] for r in want} == {1, 2}
    assert lexical.Index.read(str(tmp_path), docs.withColumn("text", F.concat("text", F.lit("!")))) is None
    assert lexical.Index.read(str(tmp_path), docs.union(docs.limit(1))) is None


def test_search_in_blocks_is_as_in_one(spark, monkeypatch):
    rows = [(i, " ".join(f"word{(i * j) % 17}" for j in range(1, 6)), f"s{i % 3}") for i in range(60)] + [(None, "word3 word4", "s0"), (5, "word3", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ask = spark.createDataFrame([(i, f"word{i} word{2 * i} other") for i in range(9)] + [(9, None)], "item_id long, text string")
    index = lexical.Index.of(docs, carry=("source",))
    found = lambda **how: sorted(map(tuple, lexical.search(index, ask, 4, **how).collect()), key=repr)
    want = found(), found(within="source"), found(where=F.col("source") == "s1")
    for name, n in (("DOCS", 7), ("QUERIES", 2), ("BROADCAST_TOKENS", 0)):
        monkeypatch.setattr(lexical, name, n)
    assert (found(), found(within="source"), found(where=F.col("source") == "s1")) == want
    assert lexical.search(docs.limit(0), ask, 3).count() == 0 and lexical.search(docs, ask.limit(0), 3).count() == 0


def test_dense_in_blocks_is_as_in_one(spark, monkeypatch):
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 6)]).alias("embedding"))
    found = lambda: sorted(map(tuple, dense.cosine_top(v, v.where("vec_id % 7 = 0"), 3).collect()))
    want = found()
    monkeypatch.setattr(dense, "ROWS", 9)
    monkeypatch.setattr(dense, "QUERIES", 2)
    assert found() == want and len(want) == 18


def test_names_by_prefix_are_counted_before_they_meet_files(spark):
    """Stems that begin with another, empty ones, names and ids that come twice; nothing is gathered on the driver for the join."""
    from loomspark.plans.code import _prefix_counts

    rows = [("a", 1, "part_1", ["part_1", "part_11", ""]), ("a", 1, "part_1", ["or", "part_1"]), ("b", 1, "part_11", ["x"]), ("c", 1, "order_1", ["part"]), ("d", 2, "part_1", ["part_11", "part_1", None]), ("e", 2, "part_12", [])]
    df = spark.createDataFrame(rows, "id string, batch long, name string, stems array<string>")
    want = {}
    for i, batch, _, _ in rows:
        stems = {s for r in rows if r[:2] == (i, batch) for s in r[3] if s}
        n = len({r[2] for r in rows if r[1] == batch and any(r[2].startswith(s) for s in stems)})
        want |= {(i, batch): n} if n else {}
    got = _prefix_counts(df)
    assert {(r["source"], r["batch"]): r["n_names"] for r in got.collect()} == want
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_merged_chunks_of_a_long_text(spark):
    """As stated by the folding expression: overlaps in any place, short and empty parts, nulls; long texts take time in proportion."""
    import random
    import time

    from loomspark.operators import files

    def plain(parts):
        a = ""
        for x in parts:
            cut = next((n for n in range(200, 19, -1) if n <= len(x) and n <= len(a) and a[-n:] == x[:n]), 0)
            a += x[cut:] if cut or a == "" else "\n" + x
        return a

    rng = random.Random(3)
    base = ["".join(rng.choice("abé ") for _ in range(n)) for n in (0, 1, 19, 20, 21, 199, 200, 201, 900, 2500)]
    cases = [[t[max(0, i - k) : i + step] for i in range(0, len(t), step)] for t in base for step, k in ((5, 25), (90, 20), (90, 19), (300, 200), (300, 201), (810, 90))]
    cases += [[], ["", "", "a"], ["a", "", "b"], ["x" * 50, "x" * 300, "x" * 10], ["ab" * 200, "ab" * 30, "c"]]
    df = spark.createDataFrame(list(enumerate(cases)) + [(-1, None), (-2, ["a", None, "b"])], "id int, p array<string>")
    got = {r["id"]: r["m"] for r in df.select("id", files.merged(F.col("p")).alias("m")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)} | {-1: None, -2: None}
    long = "".join(rng.choice("abcdefgh") for _ in range(900_000))
    parts = [long[i : i + 900] for i in range(0, len(long), 810)]
    df, began = spark.createDataFrame([(parts,)], "p array<string>"), time.perf_counter()
    assert df.select(files.merged(F.col("p"))).first()[0] == long and time.perf_counter() - began < 20


def test_hints_neither_sort_nor_gather_all_nodes(spark):
    """All nodes meet the neighbours of the hits by a hash table of those."""
    from loomspark.plans.extra import graph_hints
    from tests.conftest import SF

    plan = graph_hints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin [near" not in plan
