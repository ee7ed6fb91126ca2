"""Queries: the key hierarchy as a dependency graph, and incremental indexing of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import delta, graph
from loomspark.sources.tables import table


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind) and edges: orders depend on customers, those and suppliers on nations, those on regions."""
    node = lambda t, key, label, kind: table(spark, d, t).select(F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("id"), label.alias("label"), F.lit(kind).alias("kind"))
    nodes = (
        node("region", "r_regionkey", F.col("r_name"), "region")
        .unionByName(node("nation", "n_nationkey", F.col("n_name"), "nation"))
        .unionByName(node("customer", "c_custkey", F.col("c_name"), "customer"))
        .unionByName(node("supplier", "s_suppkey", F.col("s_name"), "supplier"))
        .unionByName(node("orders", "o_orderkey", F.col("o_orderkey").cast("string"), "order"))
    )
    edge = lambda t, a, ka, b, kb: table(spark, d, t).select(F.concat(F.lit(ka), F.col(a).cast("string")).alias("source"), F.concat(F.lit(kb), F.col(b).cast("string")).alias("target"))
    edges = (
        edge("nation", "n_nationkey", "nation/", "n_regionkey", "region/")
        .unionByName(edge("customer", "c_custkey", "customer/", "c_nationkey", "nation/"))
        .unionByName(edge("supplier", "s_suppkey", "supplier/", "s_nationkey", "nation/"))
        .unionByName(edge("orders", "o_orderkey", "order/", "o_custkey", "customer/"))
    )
    return nodes, edges


GRAPH = """nodes AS (SELECT 'region/' || r_regionkey AS id, r_name AS label, 'region' AS kind FROM region UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'nation' FROM nation
        UNION ALL SELECT 'customer/' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'order/' || o_orderkey, CAST(o_orderkey AS VARCHAR), 'order' FROM orders),
    edges AS (SELECT 'nation/' || n_nationkey AS source, 'region/' || n_regionkey AS target FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
        UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey FROM orders),
    degree AS (SELECT id, label, kind, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) USING (id))"""
REACH = "reach AS (SELECT target, source AS id, 1 AS depth FROM edges UNION SELECT r.target, e.source, r.depth + 1 FROM reach r JOIN edges e ON e.target = r.id WHERE r.depth < 10)"


def graph_build(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    per = graph.degrees(nodes, edges).groupBy("kind").agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("degrees"), F.count_if(F.col("degree") == 0).alias("isolated"))
    return per


def degree_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(*_graph(spark, d))


def hub_subgraph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.induced(edges, graph.hubs(nodes, edges, 60))


def transitive_dependents(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.dependents(edges, nodes.where("kind in ('region', 'nation')"))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.blast_radius(edges, nodes.where("kind <> 'order'"), F.col("id").rlike("supplier"))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.within(edges, nodes.where("id = 'nation/3'"), 2)


def layered_diagram(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a Mermaid diagram: a subgraph per layer of the sixty hubs, then the edges between them."""
    nodes, edges = _graph(spark, d)
    hubs = graph.hubs(nodes, edges, 60)
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    box = hubs.select(F.col("kind").alias("part"), F.concat(F.lit("    "), safe("id"), F.lit('["'), F.col("label"), F.lit('"]')).alias("line"))
    heads = hubs.select("kind").distinct().select(F.col("kind").alias("part"), F.concat(F.lit("  subgraph "), "kind").alias("line"))
    links = graph.induced(edges, hubs).select(F.lit("~edges").alias("part"), F.concat(F.lit("  "), safe("source"), F.lit(" --> "), safe("target")).alias("line"))
    return heads.unionByName(box).unionByName(links)


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and an index made of them some time ago: some weren't there, some were other, two were since removed."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("source"), F.left(F.sha2("text", 256), F.lit(16)).alias("content_hash"))
    old = docs.where("doc_id % 7 <> 0").select(F.col("source"), F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("doc_id") % 13 == 0, "b0").when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise("b1").alias("index_build"))
    second = docs.where("doc_id % 10 = 1 and doc_id % 7 <> 0").select("source", F.lit("half").alias("content_hash"), F.lit("b1").alias("index_build"))
    gone = docs.where("doc_id % 50 = 0").select(F.concat(F.lit("gone/"), "doc_id").alias("source"), "content_hash", F.lit("b1").alias("index_build"))
    return docs.select("source", "content_hash"), old.unionByName(second).unionByName(gone)


INDEXED = """cur AS (SELECT doc_id, 'doc/' || doc_id AS source, left(sha256(text), 16) AS content_hash FROM documents),
    idx AS (SELECT source, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 13 = 0 THEN 'b0' WHEN doc_id % 17 = 0 THEN NULL ELSE 'b1' END AS index_build FROM cur WHERE doc_id % 7 <> 0
        UNION ALL SELECT source, 'half', 'b1' FROM cur WHERE doc_id % 10 = 1 AND doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || doc_id, content_hash, 'b1' FROM cur WHERE doc_id % 50 = 0)"""


def delta_plan(spark: SparkSession, d: str) -> DataFrame:
    return delta.plan(*_indexed(spark, d), "b1")


def removed_sources(spark: SparkSession, d: str) -> DataFrame:
    return delta.removed(*_indexed(spark, d))


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return delta.digest(table(spark, d, "documents"), "source", "text")


def lookup_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Asked-for names to documents' sources: the same name, else the first one that ends in it, else none."""
    files = table(spark, d, "documents").select("source").distinct()
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "src").when(F.col("c_custkey") % 3 == 1, "rc").otherwise("zz"), (F.col("c_custkey") % 25).cast("string")).alias("name"))
    tails = files.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.length("source")), lambda i: F.substring("source", i, F.length("source")))).alias("tail"))
    best = tails.groupBy("tail").agg(F.min(F.struct((F.col("tail") != F.col("source")).alias("part"), "source")).alias("x"))
    return asked.join(best, F.col("name") == F.col("tail"), "left").select("c_custkey", "name", F.col("x.source").alias("source"), F.when(F.col("x").isNull(), "none").when(F.col("x.part"), "suffix").otherwise("exact").alias("how"))


def findings_delta(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the weight of orders' states before and after a date, and by how much it rose."""
    w = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    orders = table(spark, d, "orders")
    half = lambda cond, name: orders.where(cond).groupBy("o_custkey").agg(F.sum(w).alias(name))
    both = half("o_orderdate < timestamp_ntz'1996-01-01'", "before").join(half("o_orderdate >= timestamp_ntz'1996-01-01'", "after"), "o_custkey", "full").fillna(0)
    return both.withColumn("rise", F.greatest(F.lit(0), F.col("after") - F.col("before")))


QUERIES = {
    "graph_build": (graph_build, f"WITH {GRAPH} SELECT kind, count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS degrees, count(*) FILTER (degree = 0) AS isolated FROM degree GROUP BY kind"),
    "degree_hubs": (degree_hubs, f"WITH {GRAPH} SELECT id, label, kind, degree FROM degree ORDER BY degree DESC, label, id LIMIT 30"),
    "hub_subgraph": (hub_subgraph, f"WITH {GRAPH}, h AS (SELECT id FROM degree ORDER BY degree DESC, label, id LIMIT 60) SELECT source, target FROM edges WHERE source IN (FROM h) AND target IN (FROM h)"),
    "transitive_dependents": (transitive_dependents, f"WITH RECURSIVE {GRAPH}, {REACH} SELECT target, id, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE target LIKE 'region/%' OR target LIKE 'nation/%' GROUP BY target, id"),
    "blast_radius": (blast_radius, f"""WITH RECURSIVE {GRAPH}, {REACH}, m AS (SELECT target, id, min(depth) AS depth FROM reach GROUP BY 1, 2), c AS (SELECT target, count(*) FILTER (depth = 1) AS direct, count(*) AS impacted, max(depth) AS depth FROM m GROUP BY 1),
        s AS (SELECT id, coalesce(direct, 0) AS direct, coalesce(impacted, 0) AS impacted, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM nodes LEFT JOIN c ON target = id WHERE kind <> 'order'),
        k AS (SELECT *, CAST(least(10, least(10, direct + impacted // 2 + greatest(depth - 1, 0)) + CASE WHEN id LIKE 'supplier%' THEN 2 ELSE 0 END) AS INTEGER) AS score FROM s)
        SELECT *, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS level FROM k"""),
    "neighbourhood": (neighbourhood, f"""WITH RECURSIVE {GRAPH}, both_ways AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), r AS (SELECT 'nation/3' AS id, 0 AS depth UNION SELECT b.target, r.depth + 1 FROM r JOIN both_ways b ON b.source = r.id WHERE r.depth < 2)
        SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY id"""),
    "layered_diagram": (layered_diagram, f"""WITH {GRAPH}, h AS (SELECT * FROM degree ORDER BY degree DESC, label, id LIMIT 60)
        SELECT DISTINCT kind AS part, '  subgraph ' || kind AS line FROM h UNION ALL SELECT kind, '    ' || regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') || '["' || label || '"]' FROM h
        UNION ALL SELECT '~edges', '  ' || regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g') FROM edges WHERE source IN (SELECT id FROM h) AND target IN (SELECT id FROM h)"""),
    "delta_plan": (delta_plan, f"""WITH {INDEXED}, k AS (SELECT source, count(*) AS n, min(coalesce(content_hash, '')) AS h1, max(coalesce(content_hash, '')) AS h2, min(coalesce(index_build, '')) AS b1, max(coalesce(index_build, '')) AS b2 FROM idx GROUP BY source),
        a AS (SELECT coalesce(cur.source, k.source) AS source, coalesce(n, 0) AS n, CASE WHEN cur.source IS NULL THEN 'removed' WHEN k.source IS NULL THEN 'new' WHEN h1 <> content_hash OR h2 <> content_hash THEN 'changed' WHEN b1 <> 'b1' OR b2 <> 'b1' THEN 'rebuilt' ELSE 'skipped' END AS action FROM cur FULL JOIN k ON cur.source = k.source)
        SELECT source, action, CASE WHEN action IN ('new', 'skipped') THEN 0 ELSE n END AS n_stale FROM a"""),
    "removed_sources": (removed_sources, f"WITH {INDEXED} SELECT DISTINCT source FROM idx WHERE source NOT IN (SELECT source FROM cur)"),
    "content_digest": (content_digest, """WITH h AS (SELECT source, sha256(text) AS h FROM documents), p AS (SELECT source, left(h, 3) AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1, 2)
        SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY part)) AS digest FROM p GROUP BY source"""),
    "lookup_ladder": (lookup_ladder, """WITH f AS (SELECT DISTINCT source FROM documents), a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'rc' ELSE 'zz' END || CAST(c_custkey % 25 AS VARCHAR) AS name FROM customer),
        m AS (SELECT *, (SELECT min(source) FROM f WHERE source = name) AS e, (SELECT min(source) FROM f WHERE suffix(source, name)) AS s FROM a) SELECT c_custkey, name, coalesce(e, s) AS source, CASE WHEN e IS NOT NULL THEN 'exact' WHEN s IS NOT NULL THEN 'suffix' ELSE 'none' END AS how FROM m"""),
    "findings_delta": (findings_delta, """WITH o AS (SELECT o_custkey, o_orderdate < TIMESTAMP '1996-01-01' AS early, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 2 ELSE 1 END AS w FROM orders)
        SELECT o_custkey, CAST(coalesce(sum(w) FILTER (early), 0) AS BIGINT) AS before, CAST(coalesce(sum(w) FILTER (NOT early), 0) AS BIGINT) AS after, CAST(greatest(0, coalesce(sum(w) FILTER (NOT early), 0) - coalesce(sum(w) FILTER (early), 0)) AS BIGINT) AS rise FROM o GROUP BY o_custkey"""),
}
