"""Streams with state against folds over whole tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.streaming import jobs

EVENTS = "job_id string, kind string, status string, message string, result string, ts timestamp, seq long"


BASE = 1_700_000_000_000


def at(ms):
    from datetime import UTC, datetime

    return datetime.fromtimestamp((BASE + ms) / 1000, UTC).replace(tzinfo=None)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def played(spark, tmp_path, batches, schema, make, name, mode):
    """The rows of a stream over files, one file a batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = make(spark.readStream.schema(schema).parquet(str(folder)))
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")))
        query = query.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_jobs_live_for_an_hour(rocks, tmp_path):
    minute = 60_000
    batches = [
        [("a", "create", None, None, None, at(0), 1), ("a", "update", "running", "half", None, at(minute), 2), ("b", "update", "running", "nobody", None, at(minute), 3), ("c", "create", None, None, None, at(50 * minute), 4)],
        [("a", "finish", "success", None, "{}", at(5 * minute), 5), ("c", "update", "running", "on", None, at(55 * minute), 6), ("c", "update", "running", "on", None, at(55 * minute), 6)],
        [("d", "create", None, None, None, at(75 * minute), 7), ("c", "finish", "broken", "no", None, at(60 * minute), 8)],
        [("d", "update", "running", "x", None, at(80 * minute), 9), ("a", "update", "running", "late", None, at(81 * minute), 10)],
    ]
    out = played(rocks, tmp_path, batches, EVENTS, lambda s: jobs.job_states(s), "jobs", "update")
    rows = [r.asDict() for r in out.collect()]
    assert {r["job_id"] for r in rows} == {"a", "c", "d"}
    of_a = [r for r in rows if r["job_id"] == "a"]
    assert {(r["status"], r["n_progress"]) for r in of_a if r["live"]} >= {("running", 1)}
    assert any(not r["live"] for r in of_a) and all(r["message"] != "late" for r in of_a)
    of_c = [r for r in rows if r["job_id"] == "c" and r["live"]]
    assert max(r["n_progress"] for r in of_c) == 2 and any(r["status"] == "error" and r["message"] == "no" for r in of_c)
    every = rocks.createDataFrame([e for b in batches for e in b], EVENTS)
    table = {r["job_id"]: r.asDict() for r in jobs.job_table(every, BASE + 82 * minute).collect()}
    assert set(table) == {"c", "d"} and table["c"]["status"] == "error" and table["d"]["message"] == "x"
    last = {}
    for r in sorted((r for r in rows if r["live"]), key=lambda r: (r["n_progress"], r["result"] is not None)):
        last[r["job_id"]] = r
    for j in table:
        assert {k: last[j][k] for k in ("status", "message", "n_progress", "result", "created_ms")} == {k: table[j][k] for k in ("status", "message", "n_progress", "result", "created_ms")}


def test_fold_begins_anew_after_a_life():
    ev = lambda kind, ts, status=None, message=None: {"kind": kind, "ts_ms": ts, "status": status, "message": message, "result": None}
    assert jobs.fold_job(None, [ev("update", 1, "running", "m")]) is None
    assert jobs.fold_job(None, [ev("create", 1), ev("create", 5)])[4] == 1
    assert jobs.fold_job(None, [ev("create", 1), ev("create", 5 + jobs.LIFE_MS)])[4] == 5 + jobs.LIFE_MS
    assert jobs.fold_job(None, [ev("create", 0), ev("finish", 9, "weird")])[:2] == ("error", "Done.")


RUNS = "run_id string, step_id string, kind string, tool string, ts_ms long"


def brute_steps(rows):
    out = {}
    cancelled = {}
    for run, step, kind, _, ts in rows:
        if kind == "cancel":
            cancelled[run] = min(ts, cancelled.get(run, ts))
    for run, step in {(r[0], r[1]) for r in rows if r[1] is not None}:
        own = [r for r in rows if r[:2] == (run, step)]
        began = min((r[4] for r in own if r[2] == "start"), default=None)
        end = min(((r[4], r[2]) for r in own if r[2] in ("done", "failed", "skipped")), default=None)
        if began is None and end is None:
            continue
        tool = min(((r[4], r[3]) for r in own if r[3] is not None), default=(0, None))[1]
        state = end[1] if end else "interrupted" if run in cancelled else "running"
        stop = end[0] if end else max(cancelled[run], began) if run in cancelled else None
        out[(run, step)] = (tool, state, began if began is not None else end[0], stop, began is None)
    return out


def test_runs_are_the_same_after_a_killed_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(12)}", f"s{rng.randrange(5)}", rng.choice(["start", "start", "done", "failed", "skipped"]), rng.choice(["t1", "t2", None]), rng.randrange(1000)) for _ in range(200)]
    rows += [("r1", None, "cancel", None, 500), ("r2", None, "cancel", None, 1), ("r9", None, "cancel", None, 10**6), ("lone", None, "cancel", None, 3)]
    folder, out, ck = (str(tmp_path / x) for x in ("in", "kept", "ck"))
    for part in (rows[:70], rows[70:150], rows[150:]):
        spark.createDataFrame(part, RUNS).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(folder)

    def broken(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1:
            raise RuntimeError("killed after it had written")

    query = stream().writeStream.foreachBatch(broken).option("checkpointLocation", ck).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(120)
    jobs.replayed(spark, stream(), out, ck).start().awaitTermination(120)
    events = jobs.kept(spark, out)
    assert events.count() == len(rows)
    found = jobs.steps(events)
    got = {(r["run_id"], r["step_id"]): tuple(r)[2:] for r in found.collect()}
    assert got == brute_steps(rows)
    assert any(v[4] for v in got.values()) and any(v[1] == "interrupted" for v in got.values())
    states = {r["run_id"]: r for r in jobs.run_states(found).collect()}
    for run, r in states.items():
        of = [v[1] for (x, _), v in got.items() if x == run]
        want = "running" if "running" in of else "failed" if "failed" in of else "interrupted" if "interrupted" in of else "skipped" if set(of) == {"skipped"} else "done"
        assert (r["n_steps"], r["state"]) == (len(of), want)


def batch_told(text):
    text = re.sub("(?s)<think>.*?</think>", "", text)
    return text.replace("</think>", "").replace("<think>", "", 1) if "<think>" in text else text.replace("</think>", "")


THOUGHTS = ["plain", "a<think>b</think>c", "</think>x", "a<think>b", "<think><think>x</think>y", "<thin", "a</thi", "x</think><think>q</think>z<think>w</think>!", "<<think>n</think>>", "a<think>b</think></think>c<thi"]


def test_any_cut_tells_the_same():
    rng = random.Random(1)
    for text in THOUGHTS:
        want = batch_told(text)
        for _ in range(40):
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))
            tokens = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            state, out = ("telling", ""), ""
            for i, t in enumerate(tokens):
                state, more = jobs.without_thoughts(state, t, i == len(tokens) - 1)
                out += more
            assert out == want, (text, tokens)


def test_thoughts_of_a_stream(rocks, tmp_path):
    rng = random.Random(2)
    schema = "stream_id string, seq long, token string, last boolean"
    batches = [[], [], []]
    for k, text in enumerate(THOUGHTS):
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(4))
        tokens = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        for i, t in enumerate(tokens):
            batches[i * 3 // len(tokens)].append((str(k), i, t, i == len(tokens) - 1))
    batches[1].append(batches[0][0])  # a row that is played again
    out = played(rocks, tmp_path, batches, schema, jobs.told, "told", "append")
    got = {r["stream_id"]: r["t"] for r in out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("t")).collect()}
    assert {str(k): batch_told(t) for k, t in enumerate(THOUGHTS) if batch_told(t)} == {k: t for k, t in got.items() if t}
