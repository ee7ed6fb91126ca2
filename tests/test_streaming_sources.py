"""Streams run to their end over files; sources and sinks over a folder of their own."""

import json

from pyspark.sql import functions as F

from loomspark.sources import readers, writers
from loomspark.streaming import events as E
from tests.conftest import SF

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return stream.sparkSession.table(name)


def folder(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    rows.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


def test_windows_and_states_match_batch(spark, tmp_path):
    path = folder(spark, tmp_path)
    got = run(E.run_states(E.tail(spark, path, SCHEMA, 3)), "states", "complete")
    want = E.run_states(spark.read.schema(SCHEMA).parquet(path))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    windows = run(E.windowed(E.tail(spark, path, SCHEMA, 3)), "windows", "append")
    assert windows.count() > 0 and windows.exceptAll(E.windowed(spark.read.schema(SCHEMA).parquet(path))).count() == 0


def test_rolling_and_once(spark, tmp_path):
    path = folder(spark, tmp_path)
    got = run(E.rolling(E.tail(spark, path, SCHEMA, 9)), "rolling", "append")
    rows = spark.read.schema(SCHEMA).parquet(path)
    want = rows.select("event_id", F.expr("avg(value) over (partition by user_id order by event_id rows between 20 preceding and current row)").alias("w"))
    assert got.count() == rows.count()
    assert got.join(want, "event_id").where("abs(rolling - w) > 1e-9").count() == 0
    assert E.sessions(rows).agg(F.sum("n")).first()[0] == rows.count()
    once = run(E.told_once(E.tail(spark, path, SCHEMA, 9)), "once", "append")
    assert 0 < once.count() <= rows.count() and once.count() >= rows.select("user_id", "event_type").distinct().count()


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "repo"
    (root / ".git").mkdir(parents=True)
    (root / "a.py").write_text("print(1)\n")
    (root / ".git" / "b.py").write_text("x")
    (root / "c.bin").write_bytes(b"x")
    (root / "d.txt").write_bytes(b"\xff\xfe broken")
    (root / "e.txt").write_bytes("wide é".encode("utf-16"))
    (root / "f.txt").write_bytes(b"\x00\x01\xff\x00\xfe")
    files = {r["file_name"]: (r["text"], r["encoding"]) for r in readers.source_files(spark, str(root)).collect()}
    assert files == {"a.py": ("print(1)\n", "utf-8"), "d.txt": ("ÿþ broken", "iso-8859-1"), "e.txt": ("wide é", "utf-16le")}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps({"ts": i, "path": "p"}) for i in range(9)] + ["{broken"]))
    assert [r["ts"] for r in readers.json_lines(spark, f"{tmp_path}/log.jsonl", "ts int, path string", 3).collect()] == [8, 7, 6]
    (tmp_path / "doc.json").write_text('{"prompts":\n [1, 2]}')
    assert readers.json_document(spark, f"{tmp_path}/doc.json", "prompts array<int>").first()["prompts"] == [1, 2]
    (tmp_path / "git.log").write_text("a1\x1fme\x1f2020-01-01\x1ffirst\nbroken")
    assert readers.git_log(spark, f"{tmp_path}/git.log").collect()[0]["subject"] == "first"
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "id int, g string")
    writers.append(rows, f"{tmp_path}/t", "g")
    writers.replace_partitions(rows.where("id = 3"), f"{tmp_path}/t", "g")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert writers.purged(rows, rows.where("id = 1"), "id").count() == 3
    assert writers.updated(rows, F.col("id") == 2, {"g": F.lit("z")}).where("g = 'z'").count() == 1
    writers.compact(rows.where("id is not null"), f"{tmp_path}/c", "g", [F.desc("id")], 1)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [2, 3]
