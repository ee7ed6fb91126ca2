"""Queries: hints from graphs, changed nodes, shaped JSON, templates, paired steps, unread counts, anchored findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import graph, rules
from loomspark.plans.graphs import GRAPH, _graph
from loomspark.plans.review import FOUND, line_rules
from loomspark.sources.tables import table


def graph_hints(spark: SparkSession, d: str) -> DataFrame:
    """Per region whose name holds a word of a question (a nation's name in lower case, three characters and more): up to five neighbours, by label."""
    nodes, edges = _graph(spark, d)
    words = table(spark, d, "nation").select(F.col("n_nationkey").alias("q"), F.explode(F.split(F.lower("n_name"), "[^a-z0-9]+")).alias("w")).where("length(w) > 2")
    named = nodes.where("kind in ('region', 'nation')").select("id", F.explode(F.array_distinct(F.split(F.lower("label"), "[^a-z0-9]+"))).alias("w"))
    hits = words.join(named, "w").select("q", "id").distinct()
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("near")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("near")))
    # Hits are pairs of two tables of fixed size: they go to all tasks, so that no edge moves but those of a hit. Labels come by a table of the
    # neighbours, not by a sort of all nodes, nor by gathering them where they are small in compressed form alone.
    near = both.join(F.broadcast(hits), "id").select("q", "near").distinct()
    near = near.hint("shuffle_hash").join(nodes.select(F.col("id").alias("near"), "label"), "near")
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("label", "near"))).where("nth <= 5").select("q", "nth", "label")


def changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Changed paths to nodes by id or by their last part: two equi-joins, so no pair of all is made."""
    nodes, _ = _graph(spark, d)
    paths = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("old/"), F.col("s_suppkey").cast("string"))).alias("path"))
    by_id = paths.join(nodes.select("id", "kind"), F.col("path") == F.col("id")).select("path", "id", F.lit("id").alias("how"))
    tails = nodes.where("kind in ('supplier', 'nation')").select("id", F.element_at(F.split("id", "/"), -1).alias("tail"))
    by_tail = paths.withColumn("tail", F.element_at(F.split("path", "/"), -1)).join(tails, "tail").select("path", "id", F.lit("name").alias("how"))
    return by_id.unionByName(by_tail.join(by_id.select("path"), "path", "left_anti"))


def shaped_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as records with defaults: JSON by key, first line, cut, short digest."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select(
        "event_id", F.coalesce(k, F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("main")).alias("branch"),
        F.left(F.sha2(F.col("event_id").cast("string"), 256), F.lit(8)).alias("sha"), F.upper(F.left("event_type", F.lit(3))).alias("kind"),
    )


#: Templates of commands; {args} stands for what follows the command.
TEMPLATES = (("/sum", "Sum up: {args}"), ("/fix", "Find the fault in {args} and mend it."), ("/ask", "{args}"))


def template_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Turns as commands, expanded by a small table of templates."""
    command = F.get(F.array(*map(F.lit, ("/sum", "/fix", "/ask", "/none"))), (F.col("turn") % 4).cast("int"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", command.alias("command"), F.left("text", F.lit(40)).alias("args"))
    templates = spark.createDataFrame(list(TEMPLATES), "command string, template string")
    joined = turns.join(F.broadcast(templates), "command", "left")  # a list of fixed size
    return joined.select("conv_id", "turn", "command", F.coalesce(F.replace("template", F.lit("{args}"), F.col("args")), F.col("args")).alias("expanded"))


def step_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Starts (clicks) and finishes (purchases) of each user paired by their order; a finish without a start and a start without
    a finish stand alone."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, d, "events").where("event_type in ('click', 'purchase')").withColumn("nth", F.row_number().over(w))
    side = lambda t, name: rows.where(F.col("event_type") == t).select("user_id", "nth", F.col("event_id").alias(name), F.col("ts").alias(f"{name}_ts"))
    both = side("click", "started").join(side("purchase", "finished"), ["user_id", "nth"], "full")
    state = F.when(F.col("finished").isNull(), "open").when(F.col("started").isNull(), "orphan").when(F.col("finished_ts") < F.col("started_ts"), "late").otherwise("done")
    return both.select("user_id", "nth", "started", "finished", state.alias("state"))


def unread_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per user: notices, those unread, the newest unread one; errors are unread until a purchase follows."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id")).alias("seen"), "ts")
    unread = (F.col("event_type") == "error") & (F.col("seen").isNull() | (F.col("ts") > F.col("seen")))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(unread).alias("unread"), F.max_by("event_id", F.when(unread, F.struct("ts", "event_id"))).alias("newest"))


def anchored_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their document's digest: anchored where the digest is the one they were made for and the line exists."""
    docs = table(spark, d, "documents").select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("hash"), F.size(F.split("text", "\n")).alias("n_lines"))
    made = line_rules(spark, d).join(docs, "doc_id").withColumn("made_for", F.when(F.col("doc_id") % 3 == 0, "stale").otherwise(F.col("hash")))
    return made.select("doc_id", "line", "rule", ((F.col("made_for") == F.col("hash")) & (F.col("line") <= F.col("n_lines"))).alias("anchored"))


def severity_ranks(spark: SparkSession, d: str) -> DataFrame:
    return line_rules(spark, d).select("doc_id", "line", "severity", rules.severity_rank(F.col("severity")).alias("rank"))


def node_levels(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.degrees(nodes, edges).select("id", graph.level(F.col("degree"), 10, 40).alias("level"))


QUERIES = {
    "graph_hints": (graph_hints, f"""WITH {GRAPH}, w AS (SELECT n_nationkey AS q, unnest(string_split_regex(lower(n_name), '[^a-z0-9]+')) AS w FROM nation), n AS (SELECT DISTINCT id, unnest(string_split_regex(lower(label), '[^a-z0-9]+')) AS w FROM nodes WHERE kind IN ('region', 'nation')),
        h AS (SELECT DISTINCT q, id FROM w JOIN n USING (w) WHERE length(w) > 2), b AS (SELECT source AS id, target AS near FROM edges UNION ALL SELECT target, source FROM edges), k AS (SELECT DISTINCT q, near, label FROM h JOIN b USING (id) JOIN (SELECT id AS near, label FROM nodes) USING (near)),
        r AS (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY label, near) AS INTEGER) AS nth, label FROM k) SELECT * FROM r WHERE nth <= 5"""),
    "changed_nodes": (changed_nodes, f"""WITH {GRAPH}, p AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'supplier/' ELSE 'old/' END || s_suppkey AS path FROM supplier), a AS (SELECT path, id, 'id' AS how FROM p JOIN nodes ON path = id)
        SELECT * FROM a UNION ALL SELECT path, id, 'name' FROM p JOIN nodes ON string_split(path, '/')[-1] = string_split(id, '/')[-1] AND kind IN ('supplier', 'nation') WHERE path NOT IN (SELECT path FROM a)"""),
    "shaped_events": (shaped_events, "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, coalesce(json_extract_string(props, '$.none'), 'main') AS branch, left(sha256(CAST(event_id AS VARCHAR)), 8) AS sha, upper(left(event_type, 3)) AS kind FROM events"),
    "template_expansion": (template_expansion, """WITH t AS (SELECT conv_id, turn, ['/sum', '/fix', '/ask', '/none'][turn % 4 + 1] AS command, left(text, 40) AS args FROM conversations), m(command, template) AS (VALUES ('/sum', 'Sum up: {args}'), ('/fix', 'Find the fault in {args} and mend it.'), ('/ask', '{args}'))
        SELECT conv_id, turn, command, coalesce(replace(template, '{args}', args), args) AS expanded FROM t LEFT JOIN m USING (command)"""),
    "step_pairs": (step_pairs, """WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS nth FROM events WHERE event_type IN ('click', 'purchase')), s AS (SELECT user_id, nth, event_id AS started, ts AS st FROM r WHERE event_type = 'click'), f AS (SELECT user_id, nth, event_id AS finished, ts AS ft FROM r WHERE event_type = 'purchase')
        SELECT user_id, nth, started, finished, CASE WHEN finished IS NULL THEN 'open' WHEN started IS NULL THEN 'orphan' WHEN ft < st THEN 'late' ELSE 'done' END AS state FROM s FULL JOIN f USING (user_id, nth)"""),
    "unread_counts": (unread_counts, """WITH r AS (SELECT *, max(ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS seen FROM events), u AS (SELECT *, event_type = 'error' AND (seen IS NULL OR ts > seen) AS unread FROM r)
        SELECT user_id, count(*) AS n, count(*) FILTER (unread) AS unread, arg_max(event_id, (ts, event_id)) FILTER (unread) AS newest FROM u GROUP BY user_id"""),
    "anchored_findings": (anchored_findings, f"WITH {FOUND} SELECT f.doc_id, line, rule, f.doc_id % 3 <> 0 AND line <= len(string_split(text, chr(10))) AS anchored FROM found f JOIN documents USING (doc_id)"),
    "severity_ranks": (severity_ranks, f"WITH {FOUND} SELECT doc_id, line, severity, CAST(CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END AS INTEGER) AS rank FROM found"),
    "node_levels": (node_levels, f"WITH {GRAPH} SELECT id, CASE WHEN degree >= 40 THEN 'high' WHEN degree >= 10 THEN 'medium' ELSE 'low' END AS level FROM degree"),
}
