"""Queries: rules over lines, triage, plans, risk, policy, citations, grounding, measures, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import files, lexical, lookup, rules
from loomspark.plans.retrieval import BM25_SQL
from loomspark.session import checkpointed
from loomspark.sources.tables import table


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def line_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.line_findings(table(spark, d, "documents"), "doc_id", "text")


LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
RULE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(body, {_q(p)}) THEN '{r}'" for r, _, p in rules.LINE_RULES) + " END"
SEVERITY_CASE = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s, _ in rules.LINE_RULES) + " END"
FOUND = f"{LINES}, f AS (SELECT doc_id, CAST(line AS INTEGER) AS line, {RULE_CASE} AS rule FROM ln), found AS (SELECT doc_id, line, rule, {SEVERITY_CASE} AS severity FROM f WHERE rule IS NOT NULL)"


def top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The worst finding of each source's documents by severity, document and line, twelve at most, and how many more there are."""
    found = line_rules(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = found.groupBy("source").agg(F.count("*").alias("n"))
    ranked = found.withColumn("rank", rules.severity_rank(F.col("severity"))).withColumn("nth", F.expr("row_number() over (partition by source order by rank desc, doc_id, line)")).where("nth <= 12")
    return ranked.join(n, "source").select("source", "doc_id", "line", "rule", "severity", "nth", F.greatest(F.col("n") - 12, F.lit(0)).alias("more"))


def secret_assignments(spark: SparkSession, d: str) -> DataFrame:
    return rules.secret_assignments(table(spark, d, "documents"), "doc_id", "text")


def security_categories(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each category by language."""
    rows = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("body"))
    return rows.groupBy("lang").agg(*[F.count_if(F.col("body").rlike(p)).alias(name) for name, p in rules.CATEGORIES])


def key_shape_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source that hold a key of a known shape."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(*[F.count_if(F.col("text").rlike(p)).alias(name.replace("-", "_")) for name, p in rules.KEY_SHAPES])


def complexity_indicators(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.lines(table(spark, d, "documents"), "doc_id", "text")
    blank, comment = F.col("body").rlike(r"^\s*$"), F.col("body").rlike(r"^\s*(#|//)")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(blank).alias("blank"), F.count_if(comment).alias("comment"), F.count_if(F.length("body") > 120).alias("long_lines"),
        F.count_if(F.col("body").rlike(r"\b[0-9]{2,}\b")).alias("numbers"), F.max(F.length("body")).alias("longest"),
    )


def file_health(spark: SparkSession, d: str) -> DataFrame:
    """max(1, min(10, round(10 - weighted findings))) per document with findings, halves to even."""
    w = F.when(F.col("severity") == "high", 2.5).when(F.col("severity") == "medium", 1.0).otherwise(0.4)
    return line_rules(spark, d).groupBy("doc_id").agg(F.greatest(F.lit(1), F.least(F.lit(10), F.bround(10 - F.sum(w)))).cast("int").alias("health"), F.count("*").alias("n"))


def line_range_codec(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order in its ranges, and how many ranges are read back from them."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("ls"))
    text = rows.select("l_orderkey", T.encoded_ranges(F.filter("ls", lambda x: x % 3 != 0)).alias("ranges"))
    return text.select("l_orderkey", "ranges", F.size(T.decoded_ranges(F.col("ranges"))).alias("n_ranges"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: languages stand for kinds of file."""
    kind = F.when(F.col("lang") == "en", "py").when(F.col("lang") == "fr", "md").when(F.col("lang") == "de", "ts").otherwise("json")
    name = F.concat(F.get(F.array(*map(F.lit, ("auth", "main", "service", "notes", "yarn"))), (F.col("doc_id") % 5).cast("int")), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 11 == 0, "lock").otherwise(kind))
    return table(spark, d, "documents").select("doc_id", "source", "text", kind.alias("language"), name.alias("name"))


FILES = """fl AS (SELECT doc_id, source, text, CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'md' WHEN 'de' THEN 'ts' ELSE 'json' END AS language FROM documents),
    fn AS (SELECT *, ['auth', 'main', 'service', 'notes', 'yarn'][doc_id % 5 + 1] || doc_id || '.' || CASE WHEN doc_id % 11 = 0 THEN 'lock' ELSE language END AS name FROM fl),
    tri AS (SELECT *, CAST(1 + CASE WHEN length(text) < 100 AND language NOT IN ('py', 'ts') THEN -8 ELSE 0 END + CASE WHEN language IN ('py', 'ts') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(name, 'auth|security|api|service|agent|retriev|ingest') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(lower(text), 'password|token|secret|subprocess|sql|exec\\(') THEN 3 ELSE 0 END + CASE WHEN suffix(name, 'lock') THEN -5 ELSE 0 END + CASE WHEN language IN ('json', 'md') THEN -2 ELSE 0 END AS INTEGER) AS score FROM fn)"""


def triage_score(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", "name", rules.triage_score(F.col("name"), F.col("language"), F.col("text")).alias("score"))


def review_plan(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("text")
    rows = _files(spark, d).select(
        F.col("source").alias("repo"), F.col("doc_id").alias("id"), rules.triage_score(F.col("name"), F.col("language"), F.col("text")).alias("score"), size.alias("size"),
        F.lower("text").rlike("password|secret").alias("strong"), ((size < 100) | (size > 24000) | F.col("name").endswith("lock")).alias("static"),
    )
    return rules.review_plan(rows)


def risk_score(spark: SparkSession, d: str) -> DataFrame:
    """Risk of each source's documents as one change."""
    f = line_rules(spark, d).groupBy("doc_id").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.size(F.split("text", "\n")).alias("n_lines")).join(f, "doc_id", "left").fillna(0)
    per = docs.withColumn("part", F.pmod("doc_id", F.lit(40))).groupBy("source", "part").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("high").alias("high"), F.sum("n").alias("n"))
    score = rules.risk([F.least(F.lit(5), F.col("high") * 2 + F.col("n")), F.when((F.col("n_files") > 10) | (F.col("n_lines") > 400), 2).otherwise(0), F.when(F.col("n_files") >= 10, 3).when(F.col("n_files") >= 3, 2).otherwise(1)])
    per = per.withColumn("score", score.cast("int"))
    token = F.when(F.col("part") % 2 == 0, F.lit("t"))
    reason = F.when(F.col("part") % 4 == 0, "reviewed by two").otherwise("ok")
    return per.select("source", "part", "score", rules.risk_level(F.col("score")).alias("level"), rules.decision(F.col("score"), F.col("part") % 7 != 0, token, reason).alias("decision"))


def policy_ledger(spark: SparkSession, d: str) -> DataFrame:
    return risk_score(spark, d).groupBy("decision", "level").agg(F.count("*").alias("n"))


def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in plenty as a detector of poor quality, per language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.size(F.split("text", "[#*$%&|<>]")) - 1 > 20).alias("flagged"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rules.detection(rows, "lang", F.col("flagged"), F.col("quality") == 0)


def answers(index: lexical.Index, docs: DataFrame, items: DataFrame) -> DataFrame:
    """q, id: the documents that hold an item's whole text, word by word.

    A document that does holds all of the item's tokens: only documents with all of them are compared."""
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(" "))
    held = checkpointed(lexical.holding(index, items.select(F.col("text").alias("passage")), "passage"))
    both = lookup.named(docs, held, "doc_id").select("doc_id", words("text").alias("w")).join(held, "doc_id").where(F.contains("w", words("passage")))
    return both.join(items.select("item_id", F.col("text").alias("passage")), "passage").select(F.col("item_id").alias("q"), F.col("doc_id").alias("id")).distinct()


ANSWERS = r"""w AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS w FROM documents), a AS (SELECT item_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS p FROM benchmark),
    truth AS (SELECT DISTINCT item_id, doc_id FROM w JOIN a ON contains(w, p))"""


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as questions; documents that hold the whole passage are the answers."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    index = lexical.Index.of(docs)
    ranked = lexical.search(index, items, 5).select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "rank")
    return rules.retrieval_metrics(items.select(F.col("item_id").alias("q")), ranked, answers(index, docs, items))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """The first ten hits of each item gathered by source, as citations of line spans."""
    top = checkpointed(lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), 10))
    docs = lookup.named(table(spark, d, "documents"), top, "doc_id").select("doc_id", "source", (F.col("doc_id") % 100 + 1).alias("start_line"), (F.col("doc_id") % 100 + F.size(F.split("text", "\n"))).alias("end_line"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("fn"), "doc_id")).alias("symbol"))
    return rules.citations(top.withColumn("score", F.col("score") - 40).join(docs, "doc_id"), ["item_id", "source"])


def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """Line items claim a span of a part; suppliers' offers served some spans."""
    claims = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("file"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity") + 5).cast("int").alias("end")).distinct()
    served = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("file"), F.col("p_size").alias("low"), (F.col("p_size") + 4).alias("high"))
    return rules.grounded(claims, served).groupBy("file", "verdict").agg(F.count("*").alias("n"))


def file_tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.regexp_extract("url", r"://[^/]+/([a-z]+)/", 1).alias("language"))
    return files.tree(rows, "path", "language")


def lang_source_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def repo_totals(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchical totals over source and language."""
    rows = table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return rows.fillna("(all)", ["source", "lang"])


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Of the twenty first hits of each item, those that fit 14,000 characters."""
    top = checkpointed(lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), 20))
    sizes = lookup.named(table(spark, d, "documents"), top, "doc_id").select("doc_id", F.length("text").cast("long").alias("size"))
    return files.fitted(top.join(sizes, "doc_id"), "item_id", "rank", "size", 14_000)


def chunk_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into overlapping windows and put together again."""
    docs = table(spark, d, "documents").select("doc_id", "text", T.window_spans(F.col("text"), 900, 90).alias("w"))
    parts = F.transform("w", lambda w: F.substring(F.col("text"), w["start"] + 1, w["stop"] - w["start"]))
    return docs.select("doc_id", F.md5(files.merged(parts)).alias("whole_md5"))


def conversation_bundle(spark: SparkSession, d: str) -> DataFrame:
    return files.markdown(table(spark, d, "conversations"), "conv_id", "turn", "text", "role")


def part_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.fuzzy_score("red", F.col("p_name")).alias("score")).where("score is not null").orderBy(F.desc("score"), "p_partkey").limit(24)


def free_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts by predicates over a map of prices, as a catalogue filter."""
    price = F.create_map(F.lit("retail"), F.col("p_retailprice").cast("string"), F.lit("size"), F.col("p_size").cast("string"))
    cheap = F.forall(F.map_values(price), lambda x: x.try_cast("double") < 1000)
    return table(spark, d, "part").where(cheap).groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_name").alias("first"))


def pages_unsafe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Links by whether their path is safe: no traversal, no odd characters, 400 characters at most."""
    rows = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    bad = F.col("href").rlike(r'\.\.|[<>|*?"\x00-\x1f]') | (F.length("href") > 400)
    return rows.groupBy(F.when(bad, "unsafe").otherwise("safe").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("href").alias("n_distinct"))


def diff_impact(spark: SparkSession, d: str) -> DataFrame:
    """A diff per conversation, its turns as added, removed and kept lines; findings on added lines, numbered as in the new file."""
    sign = F.when(F.col("turn") % 3 == 0, "+").when(F.col("turn") % 3 == 1, "-").otherwise(" ")
    body = F.concat(sign, F.regexp_replace("text", "\n", " "), F.when(F.col("turn") % 2 == 0, ' token = "abcdef"  # TODO').otherwise(""))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    head = F.concat(F.lit("diff --git a/f b/f\n--- a/f\n+++ b/src/c"), F.col("conv_id").cast("string"), F.lit(".py\n@@ -1,4 +"), (F.col("conv_id") % 50 + 1).cast("string"), F.lit(",5 @@\n"))
    added = rules.added_lines(rows.select("conv_id", F.concat(head, "b").alias("diff")), "conv_id", "diff")
    return added.select("conv_id", "path", "line", F.col("body").rlike(rules.LINE_RULES[0][2]).alias("secret"), F.length("body").alias("size"))


QUERIES = {
    "line_rules": (line_rules, f"WITH {FOUND} SELECT * FROM found"),
    "top_findings": (top_findings, f"""WITH {FOUND}, r AS (SELECT d.source, f.*, row_number() OVER (PARTITION BY source ORDER BY CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END DESC, f.doc_id, line) AS nth, count(*) OVER (PARTITION BY source) AS n FROM found f JOIN documents d USING (doc_id))
        SELECT source, doc_id, line, rule, severity, CAST(nth AS INTEGER) AS nth, greatest(n - 12, 0) AS more FROM r WHERE nth <= 12"""),
    "secret_assignments": (secret_assignments, f"""WITH {LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, lower(regexp_extract(body, {_q(rules.SECRET_ASSIGN)}, 1)) AS name FROM ln WHERE regexp_matches(body, {_q(rules.SECRET_ASSIGN)}) AND NOT regexp_matches(regexp_extract(body, {_q(rules.SECRET_ASSIGN)}, 2), {_q(rules.PLACEHOLDER)})"""),
    "security_categories": (security_categories, "SELECT lang, " + ", ".join(f"count(*) FILTER (regexp_matches(body, {_q(p)})) AS {n}" for n, p in rules.CATEGORIES) + " FROM (SELECT lang, unnest(string_split(text, chr(10))) AS body FROM documents) GROUP BY lang"),
    "key_shape_scan": (key_shape_scan, "SELECT source, " + ", ".join(f"count(*) FILTER (regexp_matches(text, {_q(p)})) AS {n.replace('-', '_')}" for n, p in rules.KEY_SHAPES) + " FROM documents GROUP BY source"),
    "complexity_indicators": (complexity_indicators, rf"""WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(body, '^\s*$')) AS blank, count(*) FILTER (regexp_matches(body, '^\s*(#|//)')) AS comment, count(*) FILTER (length(body) > 120) AS long_lines,
        count(*) FILTER (regexp_matches(body, '\b[0-9]{{2,}}\b')) AS numbers, CAST(max(length(body)) AS INTEGER) AS longest FROM ln GROUP BY doc_id"""),
    "file_health": (file_health, f"WITH {FOUND} SELECT doc_id, CAST(greatest(1, least(10, round_even(10 - sum(CASE severity WHEN 'high' THEN 2.5 WHEN 'medium' THEN 1.0 ELSE 0.4 END), 0))) AS INTEGER) AS health, count(*) AS n FROM found GROUP BY doc_id"),
    "line_range_codec": (line_range_codec, """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_linenumber % 3 <> 0), g AS (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS island FROM l),
        r AS (SELECT l_orderkey, min(n) AS lo, max(n) AS hi FROM g GROUP BY l_orderkey, island), t AS (SELECT l_orderkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges, CAST(count(*) AS INTEGER) AS n_ranges FROM r GROUP BY l_orderkey)
        SELECT o.l_orderkey, coalesce(ranges, '') AS ranges, coalesce(n_ranges, 0) AS n_ranges FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN t USING (l_orderkey)"""),
    "triage_score": (triage_score, f"WITH {FILES} SELECT doc_id, name, score FROM tri"),
    "review_plan": (review_plan, f"""WITH {FILES}, a AS (SELECT source AS repo, doc_id AS id, score, length(text) AS size, regexp_matches(lower(text), 'password|secret') AS strong, length(text) < 100 OR length(text) > 24000 OR suffix(name, 'lock') AS static FROM tri),
        b AS (SELECT *, NOT static AND (strong OR score >= 6) AS eligible FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY repo, eligible ORDER BY score DESC, size DESC, id DESC) AS nth FROM b),
        e AS (SELECT *, CASE WHEN static THEN 'static' WHEN eligible AND nth <= 6 THEN 'single' ELSE 'batch' END AS pool FROM c), g AS (SELECT *, (row_number() OVER (PARTITION BY repo, pool ORDER BY id) - 1) // 4 AS grp FROM e),
        h AS (SELECT *, CASE WHEN pool = 'batch' AND count(*) OVER (PARTITION BY repo, pool, grp) < 3 THEN 'single' ELSE pool END AS kind FROM g) SELECT repo, id, score, kind, CAST(CASE WHEN kind = 'batch' THEN grp END AS INTEGER) AS batch FROM h"""),
    "risk_score": (risk_score, RISK := f"""WITH {FOUND}, f2 AS (SELECT doc_id, count(*) FILTER (severity = 'high') AS high, count(*) AS n FROM found GROUP BY doc_id),
        p AS (SELECT source, doc_id % 40 AS part, count(*) AS n_files, sum(len(string_split(text, chr(10)))) AS n_lines, sum(coalesce(high, 0)) AS high, sum(coalesce(n, 0)) AS n FROM documents LEFT JOIN f2 USING (doc_id) GROUP BY 1, 2),
        s AS (SELECT source, part, CAST(least(10, least(5, high * 2 + n) + CASE WHEN n_files > 10 OR n_lines > 400 THEN 2 ELSE 0 END + CASE WHEN n_files >= 10 THEN 3 WHEN n_files >= 3 THEN 2 ELSE 1 END) AS INTEGER) AS score FROM p)
        SELECT source, part, score, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level, CASE WHEN part % 7 = 0 OR score >= 10 THEN 'blocked' WHEN score >= 6 AND NOT (part % 2 = 0 AND part % 4 = 0) THEN 'needs_approval' ELSE 'allowed' END AS decision FROM s"""),
    "policy_ledger": (policy_ledger, f"SELECT decision, level, count(*) AS n FROM ({RISK}) GROUP BY 1, 2"),
    "detection_metrics": (detection_metrics, """WITH r AS (SELECT lang, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) > 20 AS f, quality = 0 AS t FROM documents JOIN labels USING (doc_id)),
        c AS (SELECT lang, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, count(*) FILTER (NOT f AND NOT t) AS tn FROM r GROUP BY lang)
        SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) END AS f1 FROM c"""),
    "retrieval_metrics": (retrieval_metrics, rf"""WITH {BM25_SQL},
        {ANSWERS}, g AS (SELECT item_id, min(rank) AS first, count(*) AS n FROM top JOIN truth USING (item_id, doc_id) WHERE rank <= 5 GROUP BY item_id)
        SELECT count(*) AS n_queries, round(100 * avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 4) AS hit_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(100 * avg(coalesce(n, 0) / 5), 4) AS precision_at_k FROM benchmark LEFT JOIN g USING (item_id)"""),
    "citations": (citations, f"""WITH {BM25_SQL}, h AS (SELECT item_id, d.source, rank, t.score - 40 AS score, d.doc_id % 100 + 1 AS a, d.doc_id % 100 + len(string_split(d.text, chr(10))) AS b, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'fn' || d.doc_id END AS symbol FROM top t JOIN documents d USING (doc_id) WHERE rank <= 10)
        SELECT item_id, source, min(a) AS start_line, max(b) AS end_line, count(*) AS chunk_count, max(score) AS score, arg_max(symbol, (score, -rank)) FILTER (symbol IS NOT NULL) AS symbol, min(rank) AS first_rank, CASE WHEN max(score) >= 2 THEN 'high' WHEN max(score) >= -3 THEN 'medium' ELSE 'low' END AS trust FROM h GROUP BY item_id, source"""),
    "grounding_check": (grounding_check, """WITH c AS (SELECT DISTINCT l_partkey % 500 AS file, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity + 5 AS INTEGER) AS e FROM lineitem), v AS (SELECT p_partkey % 300 AS file, p_size AS low, p_size + 4 AS high FROM part),
        r AS (SELECT file, CASE WHEN file NOT IN (SELECT file FROM v) THEN 'not_in_context' WHEN EXISTS (SELECT 1 FROM v WHERE v.file = c.file AND low <= s AND s <= high) THEN 'matched' ELSE 'outside_range' END AS verdict FROM c) SELECT file, verdict, count(*) AS n FROM r GROUP BY 1, 2"""),
    "file_tree_rollup": (file_tree_rollup, """WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS language FROM pages),
        u AS (SELECT language, array_to_string(parts[1:i], '/') AS folder FROM (SELECT language, parts, unnest(range(0, len(parts))) AS i FROM p)), g AS (SELECT folder, language, count(*) AS n FROM u GROUP BY 1, 2)
        SELECT folder, CAST(sum(n) AS BIGINT) AS file_count, count(*) AS n_languages, arg_min(language, (-n, language)) AS top_language, CAST(CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS INTEGER) AS depth FROM g GROUP BY folder"""),
    "lang_source_stats": (lang_source_stats, "SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_distinct, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY 1, 2"),
    "repo_totals": (repo_totals, "SELECT coalesce(source, '(all)') AS source, coalesce(lang, '(all)') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source, lang)"),
    "context_pack": (context_pack, f"""WITH RECURSIVE {BM25_SQL}, p AS (SELECT item_id, rank, length(text) AS size FROM top JOIN documents USING (doc_id) WHERE rank <= 20),
        f AS (SELECT item_id, rank, size AS used, true AS keep, size FROM p WHERE rank = 1 UNION ALL SELECT p.item_id, p.rank, CASE WHEN f.used + p.size <= 14000 THEN f.used + p.size ELSE f.used END, f.used + p.size <= 14000, p.size FROM f JOIN p ON p.item_id = f.item_id AND p.rank = f.rank + 1)
        SELECT item_id, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) FILTER (keep) AS kept, CAST(max(used) AS BIGINT) AS used FROM f GROUP BY item_id"""),
    "chunk_reconstruction": (chunk_reconstruction, None),
    "conversation_bundle": (conversation_bundle, "SELECT conv_id, '# ' || conv_id || chr(10) || chr(10) || string_agg('```' || role || chr(10) || text || chr(10) || '```', chr(10) || chr(10) ORDER BY turn) AS bundle FROM conversations GROUP BY conv_id"),
    "part_fuzzy": (part_fuzzy, """SELECT * FROM (SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'red' THEN 100 WHEN starts_with(lower(p_name), 'red') THEN 80 WHEN contains(lower(p_name), 'red') THEN 60 WHEN regexp_matches(lower(p_name), 'r.*e.*d') THEN 30 END AS INTEGER) AS score FROM part) WHERE score IS NOT NULL ORDER BY score DESC, p_partkey LIMIT 24"""),
    "free_catalog": (free_catalog, "SELECT p_brand, count(*) AS n, min(p_name) AS first FROM part WHERE p_retailprice < 1000 AND p_size < 1000 GROUP BY p_brand"),
    "unsafe_paths": (pages_unsafe_paths, r"""WITH h AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT CASE WHEN regexp_matches(href, '\.\.|[<>|*?"\x00-\x1f]') OR length(href) > 400 THEN 'unsafe' ELSE 'safe' END AS kind, count(*) AS n, count(DISTINCT href) AS n_distinct FROM h GROUP BY 1"""),
    "diff_impact": (diff_impact, """WITH m AS (SELECT conv_id, turn, replace(text, chr(10), ' ') || CASE WHEN turn % 2 = 0 THEN ' token = "abcdef"  # TODO' ELSE '' END AS body, sum(CASE WHEN turn % 3 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
        SELECT conv_id, 'src/c' || conv_id || '.py' AS path, CAST(conv_id % 50 + 1 + nth - 1 AS INTEGER) AS line, turn % 2 = 0 AS secret, CAST(length(body) AS INTEGER) AS size FROM m WHERE turn % 3 = 0"""),
}
