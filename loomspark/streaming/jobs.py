"""Streams with state of their own: jobs that live for an hour, runs rebuilt from ordered events, texts without thoughts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds after its creation at which a job is forgotten.
LIFE_MS = 3_600_000
JOB = "job_id string, status string, message string, n_progress int, result string, created_ms long, expires_ms long, live boolean"
CLOSED = ("success", "error")


def fold_job(state: tuple | None, events: list[dict], life_ms: int = LIFE_MS) -> tuple | None:
    """What a job is after events in order: (status, message, n_progress, result, created_ms).

    'create' begins a job anew (a job that lives is left as it is); 'update' sets status and message and adds to the progress; 'finish' sets status by
    its result. An event for a job that isn't there, or comes when its life is over, changes nothing.
    """
    for e in events:
        if state is not None and e["ts_ms"] - state[4] > life_ms:
            state = None
        if e["kind"] == "create":
            if state is None:
                state = ("pending", "Queued...", 0, None, e["ts_ms"])
        elif state is not None and e["kind"] == "update":
            state = (e["status"], e["message"], state[2] + 1, state[3], state[4])
        elif state is not None and e["kind"] == "finish":
            state = ("success" if e["status"] == "success" else "error", e["message"] or "Done.", state[2], e["result"] or "", state[4])
    return state


class _Jobs(StatefulProcessor):
    """A value a job and one timer: the moment at which it is forgotten."""

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, message string, n_progress int, result string, created_ms long")

    def _row(self, key, state: tuple, live: bool) -> pd.DataFrame:
        values = (key[0], *state, state[4] + self.life_ms, live)
        return pd.DataFrame([values], columns=[x.split()[0] for x in JOB.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts_ms", "seq"]).astype(object).where(lambda x: x.notna(), None).to_dict("records")
        before = tuple(self.state.get()) if self.state.exists() else None
        after = fold_job(before, events, self.life_ms)
        if after is None:
            if before is not None:  # its life ended before these events
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.state.clear()
                yield self._row(key, before, False)
            return
        if before is None or before[4] != after[4]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(after[4]) + self.life_ms)
        if after != before:
            self.state.update(after)
            yield self._row(key, after, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = tuple(self.state.get())
            self.state.clear()
            yield self._row(key, state, False)


def job_states(events: DataFrame, life_ms: int = LIFE_MS, late: str = "10 minutes") -> DataFrame:
    """A row whenever a job changes, and a last one (live is false) when its life of an hour, in the time of the events, is over.

    events: job_id, kind ('create', 'update', 'finish'), status, message, result, ts (timestamp), seq (order among equal times). Of a batch the
    events of a job are put in order; those later than the watermark are dropped by Spark. State is kept by job, in RocksDB, and ends with its timer.
    """
    rows = events.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Jobs(life_ms), outputStructType=JOB, outputMode="Update", timeMode="EventTime"
    )


def job_table(events: DataFrame, now_ms: int, life_ms: int = LIFE_MS) -> DataFrame:
    """The same fold over a table of events, as it stands at a moment: jobs that live."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        state = fold_job(None, rows.sort_values(["ts_ms", "seq"]).astype(object).where(lambda x: x.notna(), None).to_dict("records"), life_ms)
        names = [x.split()[0] for x in JOB.split(", ")]
        if state is None or now_ms - state[4] > life_ms:
            return pd.DataFrame([], columns=names)
        return pd.DataFrame([(key[0], *state, state[4] + life_ms, True)], columns=names)

    rows = events.withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return rows.groupBy("job_id").applyInPandas(fold, JOB)


RUN = "run_id string, step_id string, tool string, state string, started_ms long, ended_ms long, orphan boolean"


def steps(events: DataFrame) -> DataFrame:
    """run_id, step_id, tool, state, started_ms, ended_ms, orphan of each step, from events in any order.

    events: run_id, step_id, kind ('start', 'done', 'failed', 'skipped', 'cancel'), tool, ts_ms. The first start and the first finish of a step count, repeats
    are ignored. A finish without a start makes one of its own time (orphan). A cancelled run interrupts what is still open. Everything is a sum of
    least values, so that events may come in parts and in any order.
    """
    ended = F.col("kind").isin("done", "failed", "skipped")
    finish = F.min(F.when(ended, F.struct("ts_ms", "kind")))
    per = events.where("step_id is not null").groupBy("run_id", "step_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts_ms"))).alias("began"), finish.alias("finish"), F.min_by("tool", F.when(F.col("tool").isNotNull(), F.struct("ts_ms", "tool"))).alias("tool")
    )
    cancelled = events.where("kind = 'cancel'").groupBy("run_id").agg(F.min("ts_ms").alias("cancelled"))
    rows = per.where("began is not null or finish is not null").join(cancelled, "run_id", "left")
    state = F.when(F.col("finish").isNotNull(), F.col("finish.kind")).when(F.col("cancelled").isNotNull(), F.lit("interrupted")).otherwise(F.lit("running"))
    end = F.coalesce("finish.ts_ms", F.when(F.col("cancelled").isNotNull(), F.greatest("cancelled", "began")))
    return rows.select("run_id", "step_id", "tool", state.alias("state"), F.coalesce("began", "finish.ts_ms").alias("started_ms"), end.alias("ended_ms"), F.col("began").isNull().alias("orphan"))


def run_states(rows: DataFrame) -> DataFrame:
    """run_id, n_steps, n_done, n_failed, n_skipped, n_running, n_interrupted, state of each run from its steps: a running step makes it run, then a failed or
    interrupted one decides; a run of skipped steps alone was skipped."""
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    per = rows.groupBy("run_id").agg(F.count("*").alias("n_steps"), *[count(s) for s in ("done", "failed", "skipped", "running", "interrupted")])
    state = F.when(F.col("n_running") > 0, "running").when(F.col("n_failed") > 0, "failed").when(F.col("n_interrupted") > 0, "interrupted").when(F.col("n_skipped") == F.col("n_steps"), "skipped").otherwise("done")
    return per.withColumn("state", state)


def replayed(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str):
    """A stream that keeps the events of runs in ``folder``, each batch in a part of its own: a batch that is played again after a failure
    overwrites its part, so that what is read from all parts is the same however often it happened. Returns the writer; ``kept`` reads."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")


OPEN, CLOSE = "<think>", "</think>"


def without_thoughts(state: tuple[str, str], token: str, last: bool = False) -> tuple[tuple[str, str], str]:
    """The next state (mode, held back) and what may be told of a stream of tokens: texts between <think> and </think> are left out.

    What may be the beginning of a tag is held back until it is known; a closing tag without an opening one goes; at the end of the stream a thought that was
    never closed is told after all, and so is what was held back. However a text is cut into tokens, the parts that are told make the same text.
    """
    mode, held = state
    text, out = held + token, []
    while True:
        if mode == "thinking":
            at = text.find(CLOSE)
            if at < 0:
                break
            text, mode = text[at + len(CLOSE) :], "telling"
            continue
        at, orphan = text.find(OPEN), text.find(CLOSE)
        if orphan >= 0 and (at < 0 or orphan < at):
            out.append(text[:orphan])
            text = text[orphan + len(CLOSE) :]
        elif at >= 0:
            out.append(text[:at])
            text, mode = text[at + len(OPEN) :], "thinking"
        else:
            keep = 0 if last else max((n for tag in (OPEN, CLOSE) for n in range(1, len(tag)) if text.endswith(tag[:n])), default=0)
            out.append(text[: len(text) - keep])
            text = text[len(text) - keep :]
            break
    if last and text:
        out.append(text)
        text = ""
    return (mode, text), "".join(out)


class _Told(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("text", "mode string, held string, next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mode, held, at = tuple(self.state.get()) if self.state.exists() else ("telling", "", -1)
        state, told = (mode, held), []
        for seq, token, last in pd.concat(list(rows)).sort_values("seq")[["seq", "token", "last"]].itertuples(index=False):
            if seq <= at:  # played again
                continue
            state, out = without_thoughts(state, token or "", bool(last))
            at = int(seq)
            if out:
                told.append((key[0], at, out))
        self.state.update((*state, at))
        if told:
            yield pd.DataFrame(told, columns=["stream_id", "seq", "text"])


def told(tokens: DataFrame) -> DataFrame:
    """stream_id, seq, text: what may be shown of streams of tokens (stream_id, seq, token, last), batch by batch; a row played again is told once."""
    return tokens.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Told(), outputStructType="stream_id string, seq long, text string", outputMode="Append", timeMode="None")
