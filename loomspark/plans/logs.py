"""Queries: request logs, feeds, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import chat, logs
from loomspark.sources.tables import table


def endpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.endpoint_summary(table(spark, d, "events"), "event_type", "value", F.col("event_type") == "error")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return logs.nearest_rank(table(spark, d, "events"), "event_type", "value")


def latency_percentiles_by_user(spark: SparkSession, d: str) -> DataFrame:
    return logs.nearest_rank(table(spark, d, "events"), "user_id", "value", (50, 90, 95))


def rolling_avg(spark: SparkSession, d: str) -> DataFrame:
    return logs.rolling_mean(table(spark, d, "events"), "user_id", "event_id", "value", digits=6).select("event_id", "user_id", "rolling")


def capped_log(spark: SparkSession, d: str) -> DataFrame:
    return logs.capped(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type", "ts")


def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("bytes"))
    return logs.evicted(rows, "source", [F.desc("doc_id")], "bytes", 30, 60_000)


def activity_feed(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 of events, orders and conversations."""
    events = table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("title"))
    orders = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("title"))
    shared = orders.where("id % 5 = 0").select(F.lit("share").alias("kind"), "id", "ts", F.lit(None).cast("string").alias("title"))
    feed = events.unionByName(orders).unionByName(shared).where(F.col("ts").isNotNull())
    return feed.orderBy(F.desc("ts"), "kind", "id").limit(200)


def history_page(spark: SparkSession, d: str) -> DataFrame:
    """Clicks among the last 500 events: the filter comes after the limit."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).where("event_type = 'click'").select("event_id", "ts", "value")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events' JSON by key; what doesn't parse counts as no key."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = table(spark, d, "events").select("event_type", F.coalesce(k, F.lit(-1)).alias("k"), "value")
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def history_prune(spark: SparkSession, d: str) -> DataFrame:
    return chat.pruned(table(spark, d, "conversations"), budget=300)


def history_compact(spark: SparkSession, d: str) -> DataFrame:
    return chat.compacted(table(spark, d, "conversations"))


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return chat.cost(table(spark, d, "conversations"))


def user_transitions(spark: SparkSession, d: str) -> DataFrame:
    """How often an event type follows another of the same user; a repeated one is told once (state compare)."""
    rows = table(spark, d, "events").select("event_type", F.expr("lag(event_type) over (partition by user_id order by ts, event_id)").alias("before"))
    return rows.where("before is not null and before <> event_type").groupBy("before", "event_type").agg(F.count("*").alias("n"))


def run_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Per user: counts of steps by state and the state of the whole, failed before running before done."""
    rows = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("running"), F.count_if(F.col("event_type") == "purchase").alias("done"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.max_by("event_id", F.when(F.col("event_type") == "purchase", F.struct("value", "event_id"))).alias("largest_purchase"),
    )
    return rows.withColumn("state", F.when(F.col("failed") > 0, "failed").when(F.col("running") > 0, "running").when(F.col("done") > 0, "done").otherwise("skipped"))


CHAT = "m AS (SELECT conv_id, turn, role, text, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
QUERIES = {
    "endpoint_summary": (endpoint_summary, """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events)
        SELECT event_type, count(*) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, round(avg(value), 2) AS avg_value, max(value) AS max_value, min(value) FILTER (k = least(c, CAST(floor(c * 0.95) AS BIGINT) + 1)) AS p95 FROM r GROUP BY event_type ORDER BY n DESC, event_type LIMIT 30"""),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"),
    "latency_percentiles_by_user": (latency_percentiles_by_user, """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events)
        SELECT user_id, count(*) AS n, min(value) FILTER (k = ceil(c * 50 / 100.0)) AS p50, min(value) FILTER (k = ceil(c * 90 / 100.0)) AS p90, min(value) FILTER (k = ceil(c * 95 / 100.0)) AS p95 FROM r GROUP BY user_id"""),
    "rolling_avg": (rolling_avg, "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events"),
    "capped_log": (capped_log, "SELECT event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 50"),
    "cache_eviction": (cache_eviction, "SELECT doc_id, source, length(text) AS bytes, row_number() OVER w <= 30 AND sum(length(text)) OVER w <= 60000 AS kept FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)"),
    "activity_feed": (activity_feed, """SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts, event_type AS title FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate, o_orderstatus FROM orders UNION ALL SELECT 'share', o_orderkey, o_orderdate, NULL FROM orders WHERE o_orderkey % 5 = 0) WHERE ts IS NOT NULL ORDER BY ts DESC, kind, id LIMIT 200"""),
    "history_page": (history_page, "SELECT event_id, ts, value FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE event_type = 'click'"),
    "event_props": (event_props, "SELECT event_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "tumbling_windows": (tumbling_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "history_prune": (history_prune, f"""WITH RECURSIVE {CHAT}, total AS (SELECT conv_id, sum(cost) AS t, max(n) AS n FROM m GROUP BY conv_id),
        f AS (SELECT m.conv_id, 0::BIGINT AS back, 300::BIGINT AS budget, 0::BIGINT AS kept, true AS keep FROM (SELECT DISTINCT conv_id FROM m) m UNION ALL
            SELECT f.conv_id, m.back, CASE WHEN f.kept < 2 OR m.cost <= f.budget THEN f.budget - m.cost ELSE f.budget END, CASE WHEN f.kept < 2 OR m.cost <= f.budget THEN f.kept + 1 ELSE f.kept END, f.kept < 2 OR m.cost <= f.budget FROM f JOIN m ON m.conv_id = f.conv_id AND m.back = f.back + 1)
        SELECT m.conv_id, CAST(count(*) AS BIGINT) AS n_before, CAST(count(*) FILTER (t <= 300 OR total.n <= 2 OR keep) AS BIGINT) AS n_kept, CAST(sum(cost) AS BIGINT) AS tokens_before, CAST(sum(cost) FILTER (t <= 300 OR total.n <= 2 OR keep) AS BIGINT) AS tokens_after
        FROM m JOIN total USING (conv_id) JOIN (SELECT * FROM f WHERE back > 0) f ON f.conv_id = m.conv_id AND f.back = m.back GROUP BY m.conv_id"""),
    "history_compact": (history_compact, f"""WITH {CHAT} SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || CASE WHEN length(text) > 250 THEN left(text, 250) || '...' ELSE text END, chr(10) ORDER BY turn) AS history FROM m WHERE back <= 6 GROUP BY conv_id"""),
    "token_cost": (token_cost, """WITH t AS (SELECT conv_id, CAST(coalesce(sum(greatest(1, length(text) // 4)) FILTER (role <> 'assistant'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(greatest(1, length(text) // 4)) FILTER (role = 'assistant'), 0) AS BIGINT) AS completion_tokens FROM conversations GROUP BY conv_id)
        SELECT *, round(prompt_tokens * 1.5e-7::DOUBLE + completion_tokens * 6e-7::DOUBLE, 6) AS cost FROM t"""),
    "user_transitions": (user_transitions, "SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type GROUP BY 1, 2"),
    "run_snapshot": (run_snapshot, """SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (event_type = 'purchase') AS done, arg_max(event_type, (ts, event_id)) AS latest, arg_max(event_id, (value, event_id)) FILTER (event_type = 'purchase') AS largest_purchase,
        CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'running' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'done' ELSE 'skipped' END AS state FROM events GROUP BY user_id"""),
}
