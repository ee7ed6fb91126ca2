"""Queries: reranking, diversity, embeddings by hashing, folding, budgets, summaries, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import compare, dense, lexical, logs, rules
from loomspark.plans.retrieval import BM25_SQL, tok
from loomspark.plans.review import FOUND, LINES, _q, line_rules
from loomspark.sources.tables import table


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten first hits of each item in slices of 1,792 characters; a document's score is its best slice's share of the item's tokens."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    top = lexical.search(docs, items, 10).select("item_id", "doc_id")
    asked = items.select("item_id", T.code_tokens(F.col("text")).alias("q"))
    hits = top.join(docs.select("doc_id", "text"), "doc_id").join(asked, "item_id").select("item_id", "doc_id", "q", "text", F.explode(T.window_spans(F.col("text"), 1792, 179)).alias("w"))
    score = F.size(F.array_intersect("q", T.code_tokens(F.expr("substring(text, w.start + 1, w.stop - w.start)")))) / F.size("q")
    best = hits.select("item_id", "doc_id", score.alias("s")).groupBy("item_id", "doc_id").agg(F.round(F.max("s"), 6).alias("score"))
    return lexical.ranked(best, "item_id", "doc_id", k=5)


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    near = dense.cosine_top(v, v.where("vec_id % 50 = 0"), 20)
    return compare.diverse(near.join(v.select("vec_id", F.col("embedding").alias("v")), "vec_id").select("query_id", F.col("vec_id").alias("id"), "score", "v"))


def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Signed hashing embeddings of turns, of all their words; none is left out."""
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("t"))
    return compare.hash_embedding(turns, "id", F.col("t"))


def turn_changes(spark: SparkSession, d: str) -> DataFrame:
    """How alike each turn is to the one before it, and the lines that a diff adds and removes."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.expr("lag(text) over (partition by conv_id order by turn)").alias("before")).where("before is not null")
    return rows.select("conv_id", "turn", F.round(compare.similarity_ratio("before", "text"), 6).alias("ratio"), compare.line_changes("before", "text").alias("c")).select("conv_id", "turn", "ratio", "c.added", "c.removed")


def merged_findings(spark: SparkSession, d: str) -> DataFrame:
    """Line rules, and secret assignments on lines that no rule has."""
    ours = line_rules(spark, d).select("doc_id", "line", "rule")
    theirs = rules.secret_assignments(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line", F.concat(F.lit("assign-"), "name").alias("rule"))
    return ours.unionByName(theirs.join(ours.select("doc_id", "line"), ["doc_id", "line"], "left_anti"))


def new_findings(spark: SparkSession, d: str) -> DataFrame:
    """Rules found in odd documents of a source and not in its even ones."""
    found = line_rules(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    keys = lambda odd: found.where(F.col("doc_id") % 2 == odd).select("source", "rule", "severity").distinct()
    return keys(1).join(keys(0), ["source", "rule", "severity"], "left_anti").where(rules.severity_rank(F.col("severity")) >= 4)


def watcher_changes(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose newest order isn't the one noted, unless it has been told already; nulls compare as values."""
    orders = table(spark, d, "orders")
    head = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("head"))
    noted = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("noted"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") * 10).alias("told"))
    return noted.join(head, "o_custkey", "left").where(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("noted")) & ~F.col("head").eqNullSafe(F.col("told"))).select("o_custkey", "head", "noted")


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Pages by first folder of their url: the eight largest, and the rest together."""
    rows = table(spark, d, "pages").select(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^/]+)", 1).alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))
    largest = rows.orderBy(F.desc("n"), "layer").limit(8).select(F.col("layer").alias("named"), F.lit(True).alias("large"))
    named = rows.join(F.broadcast(largest), F.col("layer").eqNullSafe(F.col("named")), "left")
    return named.groupBy(F.when(F.col("large"), F.col("layer")).otherwise("(other)").alias("layer")).agg(F.sum("n").alias("n"))


def repo_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per source: files, share of languages as text, the five longest documents."""
    docs = table(spark, d, "documents").select("source", "doc_id", "lang", F.length("text").alias("size"))
    langs = docs.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat_ws(":", x["lang"], x["n"].cast("string"))), ",").alias("langs"))
    longest = docs.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "doc_id"))).where("nth <= 5").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("longest"))
    return langs.join(longest, "source")


def timing_shares(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each event type of each user, and its share of the user's total."""
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    total = F.sum("value").over(Window.partitionBy("user_id"))
    return last.select("user_id", "event_type", "value", F.when(total > 0, F.round(F.col("value") / total, 6)).alias("share"))


def patch_budget(spark: SparkSession, d: str) -> DataFrame:
    """Characters kept of each document of a source in order: 20,000 of one, 100,000 of all. What is kept so far is the lesser
    of the cap and the running sum, so no loop is needed."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.least(F.length("text"), F.lit(20_000)).alias("size"))
    docs = logs.running_sums(docs, "source", [F.col("doc_id")], ["size"])
    upto = F.col("upto_size")
    return docs.select("source", "doc_id", (F.least(upto, F.lit(100_000)) - F.least(upto - F.col("size"), F.lit(100_000))).cast("long").alias("kept"))


def bounded_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns cut for display: 180 characters with a mark, sizes in characters and bytes."""
    cut = F.when(F.length("text") > 180, F.concat(F.left("text", F.lit(179)), F.lit("…"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", cut.alias("shown"), F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))


def palette_search(spark: SparkSession, d: str) -> DataFrame:
    """The best 24 of the first 400 parts by name: the limit comes before the score."""
    rows = table(spark, d, "part").orderBy("p_partkey").limit(400).select("p_partkey", "p_name", T.fuzzy_score("red", F.col("p_name")).alias("score"))
    return rows.where("score is not null").orderBy(F.desc("score"), "p_partkey").limit(24)


def code_folding(spark: SparkSession, d: str) -> DataFrame:
    """Documents with findings folded: the first 4 lines and 4 about each finding are seen; other runs of 4 or more fold."""
    found = line_rules(spark, d).select("doc_id", F.explode(F.sequence(F.col("line") - 4, F.col("line") + 4)).alias("line"))
    lines = rules.lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    hidden = lines.where("line > 4").join(found.distinct(), ["doc_id", "line"], "left_anti")
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    return hidden.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).where("n >= 4").drop("island")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(40))
    return table(spark, d, "pages").select(
        "page_id", T.basename(path).alias("base"), T.extension(path).alias("ext"), T.normal_repo(F.concat(path, F.lit(".git"))).alias("repo"), slug.alias("slug"),
        F.left(F.sha2("url", 256), F.lit(16)).alias("sha"), F.md5("url").alias("md5"), F.bround(F.col("page_id") / 2).cast("long").alias("half"),
    )


def truth_match(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names to suppliers of the same number: by the name's last part, as a path's file name."""
    tail = lambda c: F.element_at(F.split(c, "#"), -1).try_cast("long")
    need = table(spark, d, "customer").select("c_custkey", tail("c_name").alias("k"))
    have = table(spark, d, "supplier").select(F.col("s_name"), tail("s_name").alias("k"))
    return need.join(have.groupBy("k").agg(F.min("s_name").alias("s_name")), "k").select("c_custkey", "s_name")


QUERIES = {
    "lexical_rerank": (lexical_rerank, f"""WITH {BM25_SQL}, c AS (SELECT item_id, doc_id FROM top WHERE rank <= 10), iq AS (SELECT item_id, {tok('text')} AS q FROM benchmark),
        w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1613)) AS s FROM documents WHERE length(text) > 0), k AS (SELECT doc_id, {tok('substr(text, s + 1, least(s + 1792, length(text)) - s)')} AS t FROM w WHERE s = 0 OR s - 1613 + 1792 < length(text)),
        b AS (SELECT item_id, doc_id, round(max(len(list_intersect(q, t)) / len(q)), 6) AS score FROM c JOIN iq USING (item_id) JOIN k USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b) SELECT * FROM r WHERE rank <= 5"""),
    "mmr_select": (mmr_select, None),
    "hash_embedding": (hash_embedding, """WITH w AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS l FROM conversations), t AS (SELECT id, 0 AS dropped, unnest(l) AS t FROM w), h AS (SELECT id, dropped, md5(lower(t)) AS h FROM t),
        s AS (SELECT id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, sum(CASE WHEN substr(h, 9, 1) >= '8' THEN -1 ELSE 1 END) AS s, CAST(max(dropped) AS INTEGER) AS dropped FROM h GROUP BY 1, 2)
        SELECT id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS weight, dropped FROM s QUALIFY s <> 0"""),
    "turn_changes": (turn_changes, None),
    "merged_findings": (merged_findings, f"""WITH {FOUND}, a AS (SELECT doc_id, CAST(line AS INTEGER) AS line, 'assign-' || lower(regexp_extract(body, {_q(rules.SECRET_ASSIGN)}, 1)) AS rule FROM ln WHERE regexp_matches(body, {_q(rules.SECRET_ASSIGN)}) AND NOT regexp_matches(regexp_extract(body, {_q(rules.SECRET_ASSIGN)}, 2), {_q(rules.PLACEHOLDER)}))
        SELECT doc_id, line, rule FROM found UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = a.doc_id AND f.line = a.line)"""),
    "new_findings": (new_findings, f"""WITH {FOUND}, k AS (SELECT DISTINCT source, rule, severity, f.doc_id % 2 AS odd FROM found f JOIN documents d USING (doc_id)) SELECT source, rule, severity FROM k WHERE odd = 1 AND severity = 'high' EXCEPT SELECT source, rule, severity FROM k WHERE odd = 0"""),
    "watcher_changes": (watcher_changes, """WITH h AS (SELECT o_custkey, max(o_orderkey) AS head FROM orders GROUP BY 1), n AS (SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS noted, CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 10 END AS told FROM customer)
        SELECT o_custkey, head, noted FROM n JOIN h USING (o_custkey) WHERE head IS DISTINCT FROM noted AND head IS DISTINCT FROM told"""),
    "layers": (layers, r"""WITH l AS (SELECT regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^/]+)', 1) AS layer, count(*) AS n FROM pages GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, layer) AS nth FROM l) SELECT CASE WHEN nth <= 8 THEN layer ELSE '(other)' END AS layer, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""),
    "repo_summary": (repo_summary, """WITH l AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), a AS (SELECT source, CAST(sum(n) AS BIGINT) AS n_files, string_agg(lang || ':' || n, ',' ORDER BY lang) AS langs FROM l GROUP BY 1),
        r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS nth FROM documents), b AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY nth) AS longest FROM r WHERE nth <= 5 GROUP BY 1) SELECT * FROM a JOIN b USING (source)"""),
    "timing_shares": (timing_shares, """WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) SELECT user_id, event_type, value, CASE WHEN sum(value) OVER w > 0 THEN round(value / sum(value) OVER w, 6) END AS share FROM l WINDOW w AS (PARTITION BY user_id)"""),
    "patch_budget": (patch_budget, """WITH d AS (SELECT source, doc_id, least(length(text), 20000) AS size FROM documents), u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM d) SELECT source, doc_id, CAST(least(upto, 100000) - least(upto - size, 100000) AS BIGINT) AS kept FROM u"""),
    "bounded_turns": (bounded_turns, "SELECT conv_id, turn, CASE WHEN length(text) > 180 THEN left(text, 179) || '…' ELSE text END AS shown, CAST(length(text) AS INTEGER) AS n_chars, CAST(strlen(text) AS INTEGER) AS n_bytes FROM conversations"),
    "palette_search": (palette_search, """SELECT * FROM (SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) = 'red' THEN 100 WHEN starts_with(lower(p_name), 'red') THEN 80 WHEN contains(lower(p_name), 'red') THEN 60 WHEN regexp_matches(lower(p_name), 'r.*e.*d') THEN 30 END AS INTEGER) AS score
        FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 400)) WHERE score IS NOT NULL ORDER BY score DESC, p_partkey LIMIT 24"""),
    "code_folding": (code_folding, f"""WITH {FOUND}, h AS (SELECT ln.doc_id, CAST(ln.line AS INTEGER) AS line FROM ln WHERE doc_id IN (SELECT doc_id FROM found) AND line > 4 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = ln.doc_id AND ln.line BETWEEN f.line - 4 AND f.line + 4)),
        i AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM h) SELECT doc_id, min(line) AS first, max(line) AS last, count(*) AS n FROM i GROUP BY doc_id, island HAVING count(*) >= 4"""),
    "scalar_functions": (scalar_functions, r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS path FROM pages) SELECT page_id, string_split(path, '/')[-1] AS base, regexp_extract(string_split(path, '/')[-1], '\.([^.]+)$', 1) AS ext, regexp_replace(regexp_replace(path || '.git', '/+$', ''), '\.git$', '') AS repo,
        left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS slug, left(sha256(url), 16) AS sha, md5(url) AS md5, CAST(round_even(page_id / 2, 0) AS BIGINT) AS half FROM p"""),
    "truth_match": (truth_match, "WITH n AS (SELECT c_custkey, TRY_CAST(string_split(c_name, '#')[-1] AS BIGINT) AS k FROM customer), h AS (SELECT TRY_CAST(string_split(s_name, '#')[-1] AS BIGINT) AS k, min(s_name) AS s_name FROM supplier GROUP BY 1) SELECT c_custkey, s_name FROM n JOIN h USING (k)"),
}
