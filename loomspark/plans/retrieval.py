"""Queries: search, fusion, limits, question analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import dense, fusion, lexical, lookup, query
from loomspark.session import checkpointed
from loomspark.sources.tables import table


def tok(t: str) -> str:
    """DuckDB: the distinct code-aware tokens of a text."""
    camel = rf"regexp_replace(regexp_replace({t}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    found = f"list_concat(list_concat(regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9]*'), regexp_extract_all({camel}, '[A-Za-z][A-Za-z0-9]*')), regexp_extract_all({t}, '[A-Za-z0-9]+'))"
    return f"list_distinct(list_filter(list_transform({found}, lambda x: lower(x)), lambda x: length(x) > 1))"


def _search(spark: SparkSession, d: str, k: int, carry: tuple[str, ...] = (), **how) -> DataFrame:
    """The k first documents of each item: item_id, doc_id, score, rank, and the one column that ranks are counted within."""
    index = lexical.Index.of(table(spark, d, "documents"), carry=carry)
    return lexical.search(index, table(spark, d, "benchmark"), k, **how)


BM25_SQL = f"""
    tk AS (SELECT doc_id, source, lang, {tok('text')} AS tokens FROM documents),
    post AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM tk),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tk),
    idf AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token), st),
    adj AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf),
    q AS (SELECT item_id, unnest({tok('text')}) AS token FROM benchmark),
    scored AS (SELECT item_id, doc_id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM q JOIN adj USING (token) JOIN post USING (token), st GROUP BY item_id, doc_id HAVING round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 10)


def _top_with_source(spark: SparkSession, d: str, k: int) -> DataFrame:
    top = checkpointed(_search(spark, d, k))
    return top.join(lookup.named(table(spark, d, "documents").select("doc_id", "source", "lang"), top, "doc_id"), "doc_id")


def bm25_topk_diversified(spark: SparkSession, d: str) -> DataFrame:
    return fusion.diversified(_top_with_source(spark, d, 15), "item_id", "source").select("item_id", "doc_id", "source", "score", "rank")


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return dense.cosine_top(v, v.where("vec_id % 50 = 0"))


DENSE_SQL = """
    dn AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6) AS score
        FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
    dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM dn) WHERE rank <= 10)"""


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A lexical list and a dense one for the queries that both have: item i beside vector 50 i."""
    words = _search(spark, d, 15).select(F.col("item_id").cast("long").alias("query_id"), "doc_id", "score", "rank")
    near = _neighbours(spark, d).select((F.col("query_id") / 50).cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank")
    return words, near


LISTS_SQL = f"""{BM25_SQL}, {DENSE_SQL},
    words AS (SELECT CAST(item_id AS BIGINT) AS query_id, doc_id, score, rank FROM top WHERE rank <= 15),
    near AS (SELECT CAST(query_id / 50 AS BIGINT) AS query_id, vec_id AS doc_id, score, rank FROM dense)"""


def rrf_flat(spark: SparkSession, d: str) -> DataFrame:
    return lexical.ranked(fusion.reciprocal_ranks([*_two_lists(spark, d)], "query_id", "doc_id"), "query_id", "doc_id", k=15)


def rrf_two_branch(spark: SparkSession, d: str) -> DataFrame:
    words, near = _two_lists(spark, d)
    one = fusion.reciprocal_ranks([words], "query_id", "doc_id")
    two = fusion.reciprocal_ranks([near], "query_id", "doc_id")
    return lexical.ranked(fusion.two_branches(one, two, "query_id", "doc_id"), "query_id", "doc_id", k=15)


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The nearest eight rows of labels 0 to 4."""
    v = table(spark, d, "embeddings")
    return dense.cosine_top(v.where(F.col("label").isin(0, 1, 2, 3, 4)), v.where("vec_id % 50 = 0"), 8)


def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.code_tokens(F.col("text"))), " ").alias("tokens"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    spans = docs.select("doc_id", "text", F.posexplode(T.window_spans(F.col("text"))).alias("child_index", "w"))
    return spans.select(
        "doc_id", "child_index", F.col("w.start").alias("start"), F.col("w.stop").alias("stop"),
        T.line_at(F.col("text"), F.col("w.start")).alias("start_line"), F.md5(F.expr("substring(text, w.start + 1, w.stop - w.start)")).alias("body_md5"),
    )


def best_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each source among the first forty of each item."""
    return fusion.best_per_parent(_top_with_source(spark, d, 40), ["item_id", "source"]).select("item_id", "source", "doc_id", "rank")


def intent_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", query.intent(F.col("text")).alias("intent"))


def _intent_sql() -> str:
    hits = {n: "(" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in ws) + ")" for n, ws in query.INTENTS.items()}
    cols = ", ".join(f"{h} AS h_{n}" for n, h in hits.items())
    best = "greatest(" + ", ".join(f"h_{n}" for n in hits) + ")"
    cases = " ".join(f"WHEN h_{n} = {best} THEN '{n}'" for n in hits)
    return f"SELECT conv_id, turn, CASE WHEN {best} = 0 THEN 'general' {cases} END AS intent FROM (SELECT conv_id, turn, {cols} FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations))"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Turns with a file scope put before them, as a reader of one source would ask."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("@src/"), F.col("role"), F.lit(".py "))).otherwise(F.lit("")), F.col("text")).alias("q"))


ASKED_SQL = "asked AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '@src/' || role || '.py ' ELSE '' END || text AS q FROM conversations)"


def file_scope(spark: SparkSession, d: str) -> DataFrame:
    rest, name = query.scope(F.col("q"))
    return _asked(spark, d).select("conv_id", "turn", rest.alias("question"), name.alias("file"))


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """The variants of each turn."""
    rows = table(spark, d, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.posexplode(query.variants(F.col("text"))).alias("nth", "variant"))


def _variants_sql() -> str:
    groups = " ".join(f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in g)} THEN text || ' {' '.join(g)}'" for g in query.SYNONYMS)
    return f"""
    WITH a AS (SELECT conv_id, turn, text, nullif(array_to_string(regexp_extract_all(text, '{query.IDENTIFIER}'), ' '), '') AS names, CASE {groups} END AS wide FROM conversations WHERE text IS NOT NULL),
    b AS (SELECT conv_id, turn, list_filter([text, CASE WHEN names <> text THEN names END, CASE WHEN wide <> text AND wide IS DISTINCT FROM names THEN wide END], lambda x: x IS NOT NULL) AS v FROM a)
    SELECT conv_id, turn, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS nth, unnest(v) AS variant FROM b"""


def intent_filter_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first ten documents of each item in the language asked for (by item), or of all where none in it is a hit."""
    langs = F.get(F.array(*map(F.lit, ("fr", "en", "de", "xx"))), (F.col("item_id") % 4).cast("int"))
    hits = _search(spark, d, 10, ("lang",), within="lang").drop("rank")  # the first ten of all are among the first ten of each
    chosen = query.scoped_or_all(hits, "item_id", F.col("lang") == langs)
    return lexical.ranked(chosen, "item_id", "doc_id", k=10).select("item_id", "doc_id", "lang", "rank", "fell_back")


def failure_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the ten first hits of each item, if anything, in the sources asked for, by item."""
    asked = (F.col("item_id") % 3 != 0) | (F.col("source") == "src1")
    hits = lexical.ranked(_search(spark, d, 10, ("source",), within="source").drop("rank").where(asked), "item_id", "doc_id", k=10)
    n = table(spark, d, "documents").select(F.count("*").alias("n_indexed"))
    per = hits.groupBy("item_id").agg(F.count("*").alias("kept"), F.countDistinct("source").alias("n_sources"))
    rows = table(spark, d, "benchmark").select("item_id", query.intent(F.col("text")).alias("intent")).join(per, "item_id", "left").crossJoin(F.broadcast(n)).fillna(0, ["kept", "n_sources"])  # n is one row
    return rows.select("item_id", "kept", "n_sources", query.diagnosis(F.col("n_indexed"), F.col("kept"), F.col("kept"), F.col("n_sources"), F.col("intent")).alias("diagnosis"))


def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", "url", T.fuzzy_score("example.net/en", F.col("url")).alias("score"))
    return rows.where("score is not null").orderBy(F.desc("score"), "page_id").limit(50)


def repo_filter(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 hits of each item among documents whose source, written in any spelling, is one of two repositories, or
    whose name holds a part: the filter comes before the ranks."""
    wanted = [f"https://host.test/{s}" for s in ("src1", "src12")]
    spelled = F.concat(F.lit(" https://host.test/"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".git").otherwise("/"))
    repo = T.normal_repo(spelled)
    hits = checkpointed(_search(spark, d, 200, ("source",), where=repo.isin(wanted) | F.lower("source").contains("src7")))
    named = lookup.named(table(spark, d, "documents"), hits, "doc_id").select("doc_id", repo.alias("repo"))
    return hits.join(named, "doc_id").select("item_id", "doc_id", "repo", "rank")


QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank FROM top WHERE rank <= 10"),
    "bm25_topk_diversified": (bm25_topk_diversified, f"""WITH {BM25_SQL},
        a AS (SELECT item_id, doc_id, source, score, rank, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS nth FROM top JOIN tk USING (doc_id) WHERE rank <= 15),
        b AS (SELECT item_id, doc_id, source, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rank) AS INTEGER) AS rank FROM a WHERE nth <= 2) SELECT * FROM b WHERE rank <= 5"""),
    "dense_topk": (_neighbours, f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, rank FROM dense"),
    "dense_filtered": (dense_filtered, f"WITH {DENSE_SQL} SELECT query_id, vec_id, score, rank FROM (SELECT dn.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM dn JOIN embeddings USING (vec_id) WHERE label <= 4 AND label >= 0) WHERE rank <= 8"),
    "rrf_flat": (rrf_flat, f"""WITH {LISTS_SQL}, s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM words UNION ALL SELECT query_id, doc_id, rank FROM near) GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 15"""),
    "rrf_two_branch": (rrf_two_branch, f"""WITH {LISTS_SQL},
        s AS (SELECT query_id, doc_id, round(coalesce(0.5::DOUBLE / (60 + w.rank), 0) + coalesce(0.5::DOUBLE / (60 + n.rank), 0), 9) AS score FROM words w FULL JOIN near n USING (query_id, doc_id)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 15"""),
    "code_tokens": (code_tokens, f"SELECT doc_id, array_to_string(list_sort({tok('text')}), ' ') AS tokens FROM documents"),
    "chunk_windows": (chunk_windows, """WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 810)) AS s FROM documents WHERE length(text) > 0),
        k AS (SELECT *, least(s + 900, length(text)) AS e FROM w WHERE s = 0 OR s - 810 + 900 < length(text))
        SELECT doc_id, CAST(s / 810 AS INTEGER) AS child_index, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS stop, CAST(length(left(text, s)) - length(replace(left(text, s), chr(10), '')) + 1 AS INTEGER) AS start_line, md5(substr(text, s + 1, e - s)) AS body_md5 FROM k"""),
    "best_per_source": (best_per_source, f"""WITH {BM25_SQL} SELECT item_id, source, doc_id, rank FROM (SELECT item_id, source, doc_id, rank, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS nth FROM top JOIN tk USING (doc_id) WHERE rank <= 40) WHERE nth = 1"""),
    "intent_routing": (intent_routing, _intent_sql()),
    "file_scope": (file_scope, rf"""WITH {ASKED_SQL}, m AS (SELECT conv_id, turn, q, regexp_extract(q, '@([A-Za-z0-9_\-\./\\]+)', 0) AS w, regexp_extract(q, '@([A-Za-z0-9_\-\./\\]+)', 1) AS f FROM asked)
        SELECT conv_id, turn, CASE WHEN w <> '' AND trim(replace(q, w, '')) <> '' THEN trim(replace(q, w, '')) ELSE q END AS question, CASE WHEN w <> '' THEN f END AS file FROM m"""),
    "query_variants": (query_variants, _variants_sql()),
    "intent_filter_fallback": (intent_filter_fallback, f"""WITH {BM25_SQL}, a AS (SELECT item_id, doc_id, lang, score, lang = ['fr', 'en', 'de', 'xx'][item_id % 4 + 1] AS m FROM top JOIN tk USING (doc_id)),
        b AS (SELECT *, count(*) FILTER (m) OVER (PARTITION BY item_id) AS n FROM a),
        c AS (SELECT item_id, doc_id, lang, n = 0 AS fell_back, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM b WHERE m OR n = 0)
        SELECT item_id, doc_id, lang, rank, fell_back FROM c WHERE rank <= 10"""),
    "failure_diagnosis": (failure_diagnosis, f"""WITH {BM25_SQL}, i AS ({_intent_sql().replace('conv_id, turn', 'item_id').replace('conversations', 'benchmark')}),
        h AS (SELECT item_id, source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS nth FROM top JOIN tk USING (doc_id) WHERE item_id % 3 <> 0 OR source = 'src1'),
        p AS (SELECT item_id, count(*) AS kept, count(DISTINCT source) AS n_sources FROM h WHERE nth <= 10 GROUP BY item_id)
        SELECT item_id, coalesce(kept, 0) AS kept, coalesce(n_sources, 0) AS n_sources, CASE WHEN (SELECT count(*) FROM documents) = 0 THEN 'P10' WHEN coalesce(kept, 0) = 0 AND intent <> 'general' THEN 'P05' WHEN coalesce(kept, 0) = 0 THEN 'P01' WHEN kept >= 3 AND n_sources = 1 THEN 'P08' END AS diagnosis FROM i LEFT JOIN p USING (item_id)"""),
    "fuzzy_search": (fuzzy_search, r"""SELECT * FROM (SELECT page_id, url, CAST(CASE WHEN lower(url) = 'example.net/en' THEN 100 WHEN starts_with(lower(url), 'example.net/en') THEN 80 WHEN contains(lower(url), 'example.net/en') THEN 60
        WHEN regexp_matches(lower(url), '(?s)e.*x.*a.*m.*p.*l.*e.*\..*n.*e.*t.*/.*e.*n') THEN 30 END AS INTEGER) AS score FROM pages) WHERE score IS NOT NULL ORDER BY score DESC, page_id LIMIT 50"""),
    "repo_filter": (repo_filter, f"""WITH {BM25_SQL}, h AS (SELECT item_id, doc_id, 'https://host.test/' || source AS repo, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM top JOIN tk USING (doc_id) WHERE source IN ('src1', 'src12') OR contains(source, 'src7')) SELECT * FROM h WHERE rank <= 200"""),
}
