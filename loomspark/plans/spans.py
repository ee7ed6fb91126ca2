"""Queries over spans: chunks by a cascade of separators, and how well retrieval finds the place that answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import cascade, loops
from loomspark.functions import text as T
from loomspark.operators import lexical, lookup, spans, upkeep
from loomspark.plans.retrieval import BM25_SQL, tok
from loomspark.session import checkpointed, shared_folder
from loomspark.sources.tables import table

SIZE, OVERLAP = 700, 150
LEGS = ["windows", "best_window", "parents"]


def separator_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document: place in characters and lines, and the digest of the text."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(cascade.chunks(F.col("text"), SIZE, OVERLAP)).alias("nth", "c"))
    return docs.select("doc_id", "nth", "c.start", "c.stop", "c.start_line", "c.end_line", F.md5("c.text").alias("text_md5"))


def _separator_sql() -> str:
    steps, names = [], {"\n\n": "chr(10) || chr(10)", "\n": "chr(10)", " ": "' '"}
    for k, s in enumerate(cascade.SEPARATORS):
        sep = names[s]
        steps.append(f"""g{k} AS (SELECT doc_id, path, unnest(string_split(t, {sep})) AS g, generate_subscripts(string_split(t, {sep}), 1) AS i FROM e{k} WHERE open AND contains(t, {sep})),
        e{k + 1} AS (SELECT * FROM e{k} WHERE NOT (open AND contains(t, {sep})) UNION ALL
            SELECT doc_id, list_append(path, i), CASE WHEN i > 1 THEN {sep} ELSE '' END || g AS t, length(CASE WHEN i > 1 THEN {sep} ELSE '' END || g) >= {SIZE}, '{k}' || path::VARCHAR FROM g{k} WHERE i > 1 OR g <> '')""")
    last = len(cascade.SEPARATORS)
    blank = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
    return rf"""WITH RECURSIVE e0 AS (SELECT doc_id, [0::BIGINT] AS path, text AS t, true AS open, '' AS of FROM documents WHERE text IS NOT NULL AND text <> ''), {", ".join(steps)},
    c AS (SELECT doc_id, path, of, unnest(regexp_extract_all(t, '(?s).{{1,50}}')) AS t, generate_subscripts(regexp_extract_all(t, '(?s).{{1,50}}'), 1) AS i FROM e{last} WHERE open),
    a AS (SELECT doc_id, path, t, of FROM e{last} WHERE NOT open UNION ALL SELECT doc_id, list_append(path, i), t, 'c' || path::VARCHAR FROM c),
    b AS (SELECT *, row_number() OVER w AS i, sum(length(t)) OVER w AS ends, sum(length(t) - length(replace(t, chr(10), ''))) OVER w AS lines, of <> coalesce(lag(of) OVER w, of) AS other FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY path)),
    p AS (SELECT *, ends - length(t) AS before, sum(other::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
    q AS (SELECT *, max(i) OVER (PARTITION BY doc_id, run ORDER BY ends RANGE BETWEEN CURRENT ROW AND ({SIZE} - length(t)) FOLLOWING) AS e,
        lead(ends) OVER (PARTITION BY doc_id, run ORDER BY i) AS following FROM p),
    q2 AS (SELECT *, CASE WHEN following IS NOT NULL THEN greatest(ends - {OVERLAP}, following - {SIZE}) END AS v FROM q),
    h AS (SELECT *, CASE WHEN v > before THEN i + 1 ELSE min(i) OVER (PARTITION BY doc_id, run ORDER BY before RANGE BETWEEN greatest(before - coalesce(v, before), 0) PRECEDING AND CURRENT ROW) END AS nxt FROM q2),
    r AS (SELECT doc_id, run, min(i) AS head FROM p GROUP BY doc_id, run UNION ALL
        SELECT r.doc_id, r.run, k.nxt FROM r JOIN h x ON x.doc_id = r.doc_id AND x.i = r.head JOIN h k ON k.doc_id = r.doc_id AND k.i = x.e WHERE k.v IS NOT NULL),
    m AS (SELECT r.doc_id, r.head, x.before AS place, x.lines - (length(x.t) - length(replace(x.t, chr(10), ''))) AS line, substr(text, CAST(x.before + 1 AS BIGINT), CAST(k.ends - x.before AS BIGINT)) AS raw
        FROM r JOIN h x ON x.doc_id = r.doc_id AND x.i = r.head JOIN h k ON k.doc_id = r.doc_id AND k.i = x.e JOIN documents d ON d.doc_id = r.doc_id),
    s AS (SELECT *, regexp_replace(raw, '^{blank}+', '') AS l, regexp_replace(regexp_replace(raw, '^{blank}+', ''), '{blank}+$', '') AS whole FROM m),
    n AS (SELECT *, place + length(raw) - length(l) AS start, line + 1 + (length(raw) - length(replace(raw, chr(10), ''))) - (length(l) - length(replace(l, chr(10), ''))) AS start_line FROM s WHERE whole <> '')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1 AS INTEGER) AS nth, CAST(start AS INTEGER) AS start, CAST(start + length(whole) AS INTEGER) AS stop, CAST(start_line AS INTEGER) AS start_line,
        CAST(start_line + length(whole) - length(replace(whole, chr(10), '')) AS INTEGER) AS end_line, md5(whole) AS text_md5 FROM n"""


def _retrieved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """asked (q, symbols), units (leg, q, rank, file, start, stop, right, text, parent), true spans (q, file, start, stop).

    Questions are benchmark passages, the symbols of one its three longest words of nine letters and more; the true spans are where a passage
    stands in a document, as often as it does. Three legs are made of the first five documents: their windows in order, the window of each that has most of the question's tokens, and
    whole documents.
    """
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    index = lexical.Index.of(docs)
    long = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)))
    by_length = F.array_sort(F.transform(long, lambda w: F.struct((-F.length(w)).alias("minus"), w.alias("w"))))
    asked = items.select(F.col("item_id").alias("q"), F.transform(F.slice(by_length, 1, 3), lambda x: x["w"]).alias("symbols"))
    top = checkpointed(lexical.search(index, items, 5).select("item_id", "doc_id", F.col("rank").alias("of")))
    rows = top.join(lookup.named(docs.select("doc_id", "text"), top, "doc_id"), "doc_id").join(items.select("item_id", F.col("text").alias("passage")), "item_id")
    rows = rows.select(F.col("item_id").alias("q"), F.col("doc_id").alias("file"), "of", F.col("text").alias("parent"), "passage", F.contains("text", F.col("passage")).alias("right"))
    rows = checkpointed(rows)  # five documents of each question
    cut = rows.select("*", F.posexplode(T.window_spans(F.col("parent"), 400, 40)).alias("child", "w"))
    cut = cut.withColumn("text", F.expr("substring(parent, w.start + 1, w.stop - w.start)")).withColumn("common", F.size(F.array_intersect(T.code_tokens(F.col("text")), T.code_tokens(F.col("passage")))))
    some = lambda df, leg, rank, start, stop, text: df.select(F.lit(leg).alias("leg"), "q", rank.cast("int").alias("rank"), "file", start.alias("start"), stop.alias("stop"), "right", text.alias("text"), "parent")
    in_order = cut.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("of", "child"))).where("nth <= 5")
    best = cut.withColumn("nth", F.row_number().over(Window.partitionBy("q", "of").orderBy(F.desc("common"), "child"))).where("nth = 1")
    window = (F.col("w.start"), F.col("w.stop"), F.col("text"))
    units = [some(in_order, LEGS[0], F.col("nth"), *window), some(best, LEGS[1], F.col("of"), *window), some(rows, LEGS[2], F.col("of"), F.lit(0), F.length("parent"), F.col("parent"))]
    # A document that holds the passage holds the tokens of its runs, but for the first and last, which may stand within longer ones.
    inner = T.code_tokens(F.regexp_replace("passage", "^[A-Za-z0-9]+|[A-Za-z0-9]+$", ""))
    passages = items.select(F.col("item_id").alias("q"), F.col("text").alias("passage")).where("passage <> ''")
    held = checkpointed(lexical.holding(index, passages, "passage", inner))
    gaps = F.expr(r"split(text, concat('\\Q', passage, '\\E'), -1)")
    found = lookup.named(docs.select("doc_id", "text"), held, "doc_id").join(held, "doc_id").where(F.contains("text", F.col("passage"))).join(passages, "passage").select("q", F.col("doc_id").alias("file"), F.length("passage").alias("n"), F.transform(gaps, lambda g: F.length(g)).alias("gaps"))
    each = found.select("q", "file", "n", "gaps", F.explode(F.sequence(F.lit(1), F.size("gaps") - 1)).alias("i"))
    start = F.expr("aggregate(slice(gaps, 1, i), 0, (s, x) -> s + x)") + (F.col("i") - 1) * F.col("n")
    true = each.select("q", "file", start.alias("start"), (start + F.col("n")).alias("stop"))
    return asked, checkpointed(reduce(DataFrame.unionByName, units)), true


def span_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per leg: whether one of the first five units is the answer, recall of symbols, and what found and true spans cover together."""
    asked, units, true = _retrieved(spark, d)
    return spans.localized(asked, units).join(spans.overlap(units, true, LEGS), "leg", "right")


_SPAN_SQL = rf"""WITH {BM25_SQL},
    y AS (SELECT item_id AS q, text AS passage, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(text, '[A-Za-z]{{9,}}')), lambda w: {{'minus': -length(w), 'w': w}}))[1:3], lambda x: x.w) AS symbols FROM benchmark),
    o AS (SELECT t.item_id AS q, t.doc_id AS file, rank AS of, d.text AS parent, passage, contains(d.text, passage) AS "right" FROM top t JOIN documents d USING (doc_id) JOIN y ON y.q = t.item_id WHERE rank <= 5),
    v AS (SELECT *, unnest(range(0, length(parent), 360)) AS s FROM o),
    k AS (SELECT *, least(s + 400, length(parent)) AS e, substr(parent, s + 1, 400) AS text FROM v WHERE s = 0 OR s - 360 + 400 < length(parent)),
    c AS (SELECT *, len(list_intersect({tok('text')}, {tok('passage')})) AS common FROM k),
    u AS (SELECT 'windows' AS leg, q, row_number() OVER (PARTITION BY q ORDER BY of, s) AS rank, file, s, e, "right", text, parent FROM k QUALIFY rank <= 5
        UNION ALL SELECT 'best_window', q, of, file, s, e, "right", text, parent FROM c QUALIFY row_number() OVER (PARTITION BY q, of ORDER BY common DESC, s) = 1
        UNION ALL SELECT 'parents', q, of, file, 0, length(parent), "right", parent, parent FROM o),
    l AS (SELECT DISTINCT leg FROM u), x AS (SELECT u.*, symbols, "right" AND len(list_filter(symbols, lambda w: contains(text, w))) > 0 AS hit FROM u JOIN y USING (q)),
    per AS (SELECT leg, q, min(CASE WHEN hit THEN rank END) AS first, count(*) FILTER (hit) AS n_right, count(*) AS n_units FROM x GROUP BY leg, q),
    seen AS (SELECT leg, q, count(DISTINCT w) AS n_seen FROM (SELECT leg, q, parent, unnest(symbols) AS w FROM x) WHERE contains(parent, w) GROUP BY leg, q),
    m AS (SELECT leg, count(*) AS n_queries, count(*) FILTER (len(symbols) > 0) AS span_scored, round(100 * avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) FILTER (len(symbols) > 0), 4) AS span_hit_at_k,
        round(avg(coalesce(1.0::DOUBLE / first, 0)) FILTER (len(symbols) > 0), 6) AS span_mrr, round(100 * avg(n_right / n_units) FILTER (len(symbols) > 0), 4) AS span_precision_at_k,
        round(100.0::DOUBLE * sum(coalesce(n_seen, 0)) FILTER (len(symbols) > 0) / sum(len(symbols)), 4) AS symbol_recall FROM l CROSS JOIN y LEFT JOIN per USING (leg, q) LEFT JOIN seen USING (leg, q) GROUP BY leg),
    g AS (SELECT y.q, doc_id AS file, length(passage) AS n, unnest(list_transform(string_split(text, passage), lambda a: length(a))) AS gap, generate_subscripts(string_split(text, passage), 1) AS i FROM documents JOIN y ON contains(text, passage)),
    t AS (SELECT q, file, n, i, sum(gap) OVER (PARTITION BY q, file ORDER BY i) + (i - 1) * n AS start FROM g QUALIFY i < max(i) OVER (PARTITION BY q, file)),
    f AS (SELECT DISTINCT leg, q, file, unnest(range(s, e)) AS place FROM u), tr AS (SELECT DISTINCT q, file, unnest(range(CAST(start AS BIGINT), CAST(start + n AS BIGINT))) AS place FROM t),
    w AS (SELECT leg, (SELECT count(*) FROM f WHERE f.leg = l.leg) AS found_length, (SELECT count(*) FROM tr) AS true_length, (SELECT count(*) FROM f JOIN tr USING (q, file, place) WHERE f.leg = l.leg) AS both_length FROM l)
    SELECT m.*, found_length, true_length, both_length, round(100.0::DOUBLE * both_length / nullif(true_length, 0), 4) AS span_recall, round(100.0::DOUBLE * both_length / nullif(found_length, 0), 4) AS span_precision FROM m JOIN w USING (leg)"""

def index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The first ten documents of each item, from a stored index that began without every seventh document and with other texts of every fifth, and
    then followed the documents as they are."""
    docs, folder = table(spark, d, "documents"), shared_folder(spark, "index")
    past = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("an older version "), F.reverse("text"))).otherwise(F.col("text")))
    extra = docs.where("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)  # these are gone now
    version = upkeep.advance(docs, folder, upkeep.start(past.unionByName(extra), folder))
    return lexical.search(upkeep.index(spark, folder, version), table(spark, d, "benchmark"), 10)


def loop_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Loops within loops of code that is made of the words of every document: a word's length tells its line's indent, and what stands there."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z]+"), lambda w: w != "")
    line = lambda w: F.concat(F.repeat(F.lit(" "), F.length(w) % 5), F.when(F.length(w) % 3 == 0, "for x in y:").when(F.length(w) == 7, "except:").otherwise(w))
    code = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(words, line), "\n").alias("code"))
    return code.select("doc_id", loops.nesting(F.col("code")).alias("n")).select("doc_id", "n.nested_loops", "n.bare_excepts")


#: A loop is nested if one before it is indented less, and no line since then as little as that one: the last line indented less, before any other, is a loop.
_LOOP_SQL = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[^A-Za-z]+'), lambda x: x <> '') AS ws FROM documents),
    l AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM w), k AS (SELECT doc_id, i, length(w) % 5 AS d, length(w) % 3 = 0 AS is_loop, length(w) = 7 AS is_bare FROM l),
    m AS (SELECT *, max(CASE WHEN d = 0 THEN i END) OVER b AS p0, max(CASE WHEN d <= 1 THEN i END) OVER b AS p1, max(CASE WHEN d <= 2 THEN i END) OVER b AS p2, max(CASE WHEN d <= 3 THEN i END) OVER b AS p3,
        max(CASE WHEN d = 0 AND is_loop THEN i END) OVER b AS l0, max(CASE WHEN d = 1 AND is_loop THEN i END) OVER b AS l1, max(CASE WHEN d = 2 AND is_loop THEN i END) OVER b AS l2, max(CASE WHEN d = 3 AND is_loop THEN i END) OVER b AS l3
        FROM k WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    n AS (SELECT doc_id, is_bare, is_loop AND ((d > 0 AND l0 = p0) OR (d > 1 AND l1 = p1) OR (d > 2 AND l2 = p2) OR (d > 3 AND l3 = p3)) AS nested FROM m)
    SELECT d.doc_id, CAST(count(*) FILTER (nested) AS INTEGER) AS nested_loops, CAST(count(*) FILTER (is_bare) AS INTEGER) AS bare_excepts FROM (SELECT doc_id FROM documents) d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

QUERIES = {
    "loop_nesting": (loop_nesting, _LOOP_SQL),
    "index_upkeep": (index_upkeep, f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank FROM top WHERE rank <= 10"),
    "separator_chunks": (separator_chunks, _separator_sql()),
    "span_metrics": (span_metrics, _SPAN_SQL),
}
