"""Queries over source files that Spark writes from the key tables: imports, batches, manifests, comments, claims, windows.

Orders are Python files that import their customer and parts, customers JavaScript, parts Go files that import another part,
nations Rust files that use the next nation: a graph with hubs, several parents and cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import parse
from loomspark.functions import text as T
from loomspark.operators import fusion, graph, lexical, logs, lookup, query, rules
from loomspark.plans import review
from loomspark.plans.retrieval import BM25_SQL
from loomspark.session import checkpointed
from loomspark.sources.tables import table


def _text(x: Column) -> Column:
    return x.cast("string")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """id (a path), language, name, text of each file."""
    n_parts = table(spark, d, "part").agg(F.count("*").alias("n_parts"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ps"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<bigint>")
    imports = F.array_join(F.transform(F.coalesce("ps", none), lambda p: F.concat(F.lit("import app.part_"), _text(p))), "\n")
    py = F.concat(
        F.lit("from app.cust_"), _text(F.col("o_custkey")), F.lit(" import name\n"), imports, F.lit("\n\ndef run_"), _text(F.col("o_orderkey")), F.lit("():\n    return 1\n")
    )
    js = F.concat(
        F.lit("import x from './nation_"), _text(F.col("c_nationkey")), F.lit("'\nconst y = require('../lib/part_"), _text(F.col("c_custkey") % 50 + 1), F.lit(".js')\n")
    )
    go = F.concat(F.lit('import (\n\t"fmt"\n\tp "lib/part_'), _text(F.col("p_partkey") * 7 % F.col("n_parts") + 1), F.lit('"\n)\n'))
    rs = F.concat(F.lit("use crate::nation_"), _text((F.col("n_nationkey") + 1) % 25), F.lit(";\nmod region_"), _text(F.col("n_regionkey")), F.lit(";\n"))

    def of(df: DataFrame, kind: str, key: str, ext: str, body: Column) -> DataFrame:
        name = F.concat(F.lit(f"{kind}_"), _text(F.col(key)))
        return df.select(F.concat(F.lit("src/"), name, F.lit(f".{ext}")).alias("id"), F.lit(ext).alias("language"), name.alias("name"), body.alias("text"))

    parts = table(spark, d, "part").crossJoin(F.broadcast(n_parts))  # one row
    return (
        of(orders, "order", "o_orderkey", "py", py)
        .unionByName(of(table(spark, d, "customer"), "cust", "c_custkey", "js", js))
        .unionByName(of(parts, "part", "p_partkey", "go", go))
        .unionByName(of(table(spark, d, "nation"), "nation", "n_nationkey", "rs", rs))
        .unionByName(of(table(spark, d, "region"), "region", "r_regionkey", "rs", F.lit("")))
    )


FILES = """lp AS (SELECT l_orderkey, string_agg('import app.part_' || p, chr(10) ORDER BY p) AS ps FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) GROUP BY l_orderkey),
files AS (
    SELECT 'src/order_' || o_orderkey || '.py' AS id, 'py' AS language, 'order_' || o_orderkey AS name,
        'from app.cust_' || o_custkey || ' import name' || chr(10) || coalesce(ps, '') || chr(10) || chr(10) || 'def run_' || o_orderkey || '():' || chr(10) || '    return 1' || chr(10) AS text
    FROM orders LEFT JOIN lp ON l_orderkey = o_orderkey
    UNION ALL SELECT 'src/cust_' || c_custkey || '.js', 'js', 'cust_' || c_custkey,
        'import x from ''./nation_' || c_nationkey || '''' || chr(10) || 'const y = require(''../lib/part_' || (c_custkey % 50 + 1) || '.js'')' || chr(10) FROM customer
    UNION ALL SELECT 'src/part_' || p_partkey || '.go', 'go', 'part_' || p_partkey,
        'import (' || chr(10) || chr(9) || '"fmt"' || chr(10) || chr(9) || 'p "lib/part_' || (p_partkey * 7 % (SELECT count(*) FROM part) + 1) || '"' || chr(10) || ')' || chr(10) FROM part
    UNION ALL SELECT 'src/nation_' || n_nationkey || '.rs', 'rs', 'nation_' || n_nationkey,
        'use crate::nation_' || ((n_nationkey + 1) % 25) || ';' || chr(10) || 'mod region_' || n_regionkey || ';' || chr(10) FROM nation
    UNION ALL SELECT 'src/region_' || r_regionkey || '.rs', 'rs', 'region_' || r_regionkey, '' FROM region)"""


def _modules() -> Column:
    """The distinct modules that a file imports, by its language."""
    found = F.array().cast("array<string>")
    for language in parse.IMPORTS:
        found = F.when(F.col("language") == language, parse.imported(F.col("text"), language)).otherwise(found)
    return found


def _stems() -> Column:
    """The distinct stems of what a file imports."""
    return F.array_distinct(F.transform(_modules(), parse.stem))


def _imports(files: DataFrame) -> DataFrame:
    """source, stem of each import of each file (null where it has none); a pair comes several times where an id does, or where modules share a stem.

    Modules are a projection of their own, which goes into each kind of files and leaves its own patterns there: all patterns in one
    method are more than the JVM compiles. An outer explode keeps Spark from asking for the size of the modules first, by matching them again.
    """
    each = files.select(F.col("id").alias("source"), _modules().alias("modules")).select("source", F.explode_outer("modules").alias("module"))
    return each.select("source", parse.stem(F.col("module")).alias("stem"))


def _edges(files: DataFrame) -> DataFrame:
    return graph.resolved(_imports(files), files.select("id", F.col("name").alias("stem")))


def _imports_sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    every = {k: ", ".join(f"regexp_extract_all(text, {quoted(p)}, 1)" for p in ps) for k, ps in parse.IMPORTS.items()}
    cases = " ".join(f"WHEN '{k}' THEN flatten([{v}])" for k, v in every.items())
    return rf"""{FILES}, raw AS (SELECT DISTINCT id AS source, replace(unnest(CASE language {cases} ELSE [] END), '::', '.') AS module FROM files),
    imports AS (SELECT DISTINCT source, lower(CASE WHEN contains(module, '/') THEN regexp_replace(list_last(string_split(regexp_replace(module, '^[.]+', ''), '/')), '\..*$', '')
        ELSE list_last(string_split(module, '.')) END) AS stem FROM raw)"""


EDGES = ", edges AS (SELECT DISTINCT source, min(id) AS target FROM imports JOIN files ON name = stem AND id <> source GROUP BY source, stem), e AS (SELECT DISTINCT source, target FROM edges)"


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each import, read from the text, and the file that it names."""
    return _edges(_files(spark, d))


def import_graph(spark: SparkSession, d: str) -> DataFrame:
    """Per language: files, edges out and in, and files that neither import nor are imported."""
    files = _files(spark, d)
    edges = _edges(files)
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    in_ = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    per = files.select("id", "language").join(out, "id", "left").join(in_, "id", "left").fillna(0, ["n_out", "n_in"])
    alone = F.count_if((F.col("n_out") == 0) & (F.col("n_in") == 0))
    return per.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"), alone.alias("isolated"))


def import_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The thirty files of most edges."""
    files = _files(spark, d)
    return graph.hubs(files.select("id", F.col("name").alias("label")), _edges(files)).select("id", "label", "degree")


def import_reach(spark: SparkSession, d: str) -> DataFrame:
    """What depends on three files, directly or through others, at most four steps away; nations import each other in a ring."""
    files = _files(spark, d)
    return graph.dependents(_edges(files), files.where("name in ('nation_0', 'nation_5', 'part_1')").select("id"), 4)


def file_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Per file: how many windows of 60 characters, and how many imports its first one bears."""
    spans = _files(spark, d).select("id", "text", F.posexplode(T.window_spans(F.col("text"), 60, 10)).alias("nth", "w"))
    body = F.expr("substring(text, w.start + 1, w.stop - w.start)")
    lines = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^(?:import|from|use|const) "), F.lit(0)))
    first = F.max(F.when(F.col("nth") == 0, F.col("n")))
    return spans.select("id", "nth", lines.alias("n")).groupBy("id").agg(F.count("*").alias("chunk_count"), first.alias("first_imports"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """Files in batches: orders and parts by the hundreds of their numbers."""
    number = F.regexp_extract("name", r"([0-9]+)$", 1).cast("long")
    return _files(spark, d).where("language in ('py', 'go')").withColumn("batch", F.floor(number / 100).cast("long"))


BATCHES = "b AS (SELECT *, CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) // 100 AS batch FROM files WHERE language IN ('py', 'go'))"


def batch_context(spark: SparkSession, d: str) -> DataFrame:
    """Per file of a batch: what it defines (20 at most), which files of its batch it imports and which use it (10 at most)."""
    rows = _batches(spark, d)
    exports = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(?m)^(?:def|class)[ \t]+(\w+)"), F.lit(1)), 1, 20), ",")
    of = lambda side, batch: rows.select(F.col("id").alias(side), F.col("batch").alias(batch))
    edges = _edges(rows).join(of("source", "b1"), "source").join(of("target", "b2"), "target").where("b1 = b2")

    def listed(by: str, other: str, name: str) -> DataFrame:
        """The first ten by name: ranked first, so that a hub brings no long list to a task."""
        w = Window.partitionBy(by).orderBy(other)
        first = edges.withColumn("nth", F.row_number().over(w)).where("nth <= 10")
        return first.groupBy(F.col(by).alias("id")).agg(F.array_join(F.array_sort(F.collect_list(other)), ",").alias(name))

    out = rows.select("id", "batch", exports.alias("exports"))
    out = out.join(listed("source", "target", "imports"), "id", "left").join(listed("target", "source", "used_by"), "id", "left")
    return out.fillna("", ["imports", "used_by"])


def _prefix_counts(rows: DataFrame) -> DataFrame:
    """source, batch, n_names: to rows (id, batch, name, stems) how many names of its batch begin with one of its stems.

    Names are counted by each of their beginnings before the join, so that no name is paired with a file. A stem that begins with another
    one of its file finds no further names, and the names of the remaining stems are disjoint: the counts add up. The join is told to
    sort: what is small when it is shuffled in compressed form may be far too large to be gathered and sent to all.
    """
    heads = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring("name", F.lit(1), n))
    names = rows.where("name <> ''").select("batch", "name").distinct()
    counts = names.select("batch", F.explode(heads).alias("stem")).groupBy("batch", "stem").agg(F.count("*").alias("n"))
    files = rows.groupBy(F.col("id").alias("source"), "batch").agg(F.flatten(F.collect_set("stems")).alias("stems"))
    stems = files.select("source", "batch", F.filter(F.array_distinct("stems"), lambda s: s != "").alias("stems"))
    shortest = F.expr("filter(stems, s -> not exists(stems, t -> t <> s and startswith(s, t)))")
    asked = stems.select("source", "batch", F.explode(shortest).alias("stem"))
    return asked.join(counts.hint("merge"), ["batch", "stem"]).groupBy("source", "batch").agg(F.sum("n").alias("n_names"))


def batch_import_map(spark: SparkSession, d: str) -> DataFrame:
    """Imports of a batch held against the names in it, by prefix: how many names begin with what each file imports."""
    return _prefix_counts(_batches(spark, d).select("id", "batch", "name", _stems().alias("stems")))


def _review(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that quote documents: thoughts, claims, marks, sections, and comments in fenced JSON, some misquoted."""
    line = F.element_at(F.split("text", "\n"), 1)
    short = F.substring(F.regexp_replace(line, r"[^A-Za-z ]", ""), 1, 40)
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(short, F.lit("x"))).otherwise(short)
    name = F.concat(F.lit("f"), _text(F.col("doc_id")), F.lit(".py"))
    comment = lambda at, said, what: F.struct(name.alias("file"), F.lit(at).alias("line"), said.alias("quote"), F.lit(what).alias("comment"))
    json = F.to_json(F.array(comment(1, quote, "why?"), comment(2, F.lit("no such line"), "hm")))
    at = _text(F.col("doc_id") % 90 + 1)
    review = F.concat(
        F.lit("<think>see old.py:9 "), name, F.lit("</think>Lines 2-4 in `"), name, F.lit("` and then "), name, F.lit(":"), at, F.lit("-"), at,
        F.lit(" hold. __NOTE__ok__NOTE_END__\n```json\n"), json, F.lit("\n```\n```json\nnot json\n```\nFILE: "), name, F.lit("\nfine\nEND FILE\nFILE: src/"), name, F.lit("\nbad\nEND FILE\n"),
    )
    return table(spark, d, "documents").where("text is not null").select("doc_id", name.alias("name"), short.alias("source_line"), review.alias("review"))


REVIEW = """src AS (SELECT doc_id, 'f' || doc_id || '.py' AS name, substr(regexp_replace(string_split(text, chr(10))[1], '[^A-Za-z ]', '', 'g'), 1, 40) AS source_line FROM documents WHERE text IS NOT NULL)"""


def quoted_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of a review whose quote is the line that they name, as it stands."""
    rows = _review(spark, d).select("doc_id", "source_line", F.explode(parse.comments(F.col("review"))).alias("c"))
    held = rows.where((F.col("c.line") == 1) & (F.col("c.quote") == F.col("source_line")))
    return held.select("doc_id", "c.file", "c.line", "c.comment")


def claims_found(spark: SparkSession, d: str) -> DataFrame:
    """What a review cites outside its thoughts, with the label that a citation gets, in the order of the text."""
    said = _review(spark, d).select("doc_id", parse.without_thoughts(F.col("review")).alias("r"))
    said = said.select("doc_id", F.posexplode(parse.claims(F.col("r"))).alias("nth", "c"))
    return said.select("doc_id", "nth", F.col("c.file").alias("file"), parse.cited_as(F.col("c.file"), F.col("c.start"), F.col("c.end")).alias("label"))


def review_marks(spark: SparkSession, d: str) -> DataFrame:
    """The marks of a review, by kind."""
    rows = _review(spark, d).select("doc_id", F.explode(parse.markers(F.col("review"))).alias("m"))
    return rows.select("doc_id", F.col("m.kind").alias("kind"), F.col("m.body").alias("body"))


def review_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a batched review given to files: by path, else by the name alone."""
    rows = _review(spark, d).select("doc_id", F.explode(parse.sections(F.col("review"))).alias("s"))
    rows = rows.select("doc_id", F.col("s.file").alias("file"), F.trim(F.replace("s.body", F.lit("\n"), F.lit(" "))).alias("body"))
    known = _review(spark, d).select(F.col("name").alias("path"), F.col("doc_id").alias("owner"))
    by_path = rows.join(known, F.col("file") == F.col("path"), "left")
    again = known.select(F.col("path").alias("p2"), F.col("owner").alias("o2"))
    by_name = by_path.join(again, F.col("owner").isNull() & (T.basename(F.col("file")) == F.col("p2")), "left")
    return by_name.select("doc_id", "file", "body", F.coalesce("owner", "o2").alias("owner"), F.col("owner").isNotNull().alias("exact"))


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Packages of three kinds of manifests written from suppliers: name, version where one is pinned, ecosystem."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("lib"), _text(F.col("s_suppkey"))).alias("n"), _text(F.col("s_suppkey") % 9).alias("v"))
    pip = F.concat(F.lit("# pins\n"), "n", F.lit("=="), "v", F.lit(".2\nother>=1.0  # loose\n"))
    npm = F.concat(F.lit('{"dependencies": {"'), "n", F.lit('": "^'), "v", F.lit('.1.0"}, "devDependencies": {"jest": "latest"}}'))
    go = F.concat(F.lit("module x\nrequire (\n\tgithub.com/a/"), "n", F.lit(" v1."), "v", F.lit(".0\n)\nrequire golang.org/x/net v0.1.2\n"))
    found = {"pip": parse.requirements(pip), "npm": parse.package_json(npm), "go": parse.go_modules(go)}
    kinds = F.array(*[F.struct(F.lit(k).alias("ecosystem"), p.alias("packages")) for k, p in found.items()])
    each = s.select("s_suppkey", F.explode(kinds).alias("k")).select("s_suppkey", "k.ecosystem", F.explode("k.packages").alias("p"))
    return each.select("s_suppkey", "ecosystem", F.col("p.name").alias("name"), F.col("p.version").alias("version"))


def _windows(docs: DataFrame) -> DataFrame:
    rows = docs.where("text is not null").select("doc_id", F.length("text").alias("parent_chars"), F.posexplode(T.window_spans(F.col("text"), 400, 40)).alias("child", "w"))
    return rows.select("doc_id", "child", F.col("w.start").alias("start"), F.col("w.stop").alias("stop"), "parent_chars")


def parent_windows(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, child, start, stop, parent_chars: windows of 400 characters that know their parent."""
    return _windows(table(spark, d, "documents"))


CHILDREN = """w AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 360)) AS s FROM documents WHERE text IS NOT NULL AND length(text) > 0),
    children AS (SELECT doc_id, CAST(s / 360 AS INTEGER) AS child, CAST(s AS INTEGER) AS start, CAST(least(s + 400, n) AS INTEGER) AS stop, CAST(n AS INTEGER) AS parent_chars
        FROM w WHERE s = 0 OR s - 360 + 400 < n)"""


def parent_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The ten first documents of each item, each once, as parents: the digest of their text and how many windows stand for them."""
    top = checkpointed(lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), 10).select("item_id", "doc_id", "rank"))
    docs = lookup.named(table(spark, d, "documents").select("doc_id", "text"), top, "doc_id")
    parents = docs.select("doc_id", F.md5("text").alias("parent_md5"))
    n = _windows(docs).groupBy("doc_id").agg(F.count("*").alias("n_children"))
    return top.join(parents, "doc_id").join(n, "doc_id").select("item_id", "doc_id", "rank", "parent_md5", "n_children")


def chunk_joined(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a document joined as they are, line break between, overlaps and all."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", T.window_spans(F.col("text"), 900, 90).alias("w"))
    parts = F.transform("w", lambda w: F.substring(F.col("text"), w["start"] + 1, w["stop"] - w["start"]))
    return docs.select("doc_id", F.size("w").alias("n_chunks"), F.md5(F.array_join(parts, "\n")).alias("joined_md5"))


#: A filter as a search gets it.
FILTER = {"$and": [{"$or": [{"lang": {"$in": ["fr", "de"]}}, {"source": {"$contains": "rc1"}}]}, {"text": {"$contains": "e"}}]}


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(query.condition(FILTER)).select("doc_id", "lang", "source")


def units_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Windows per document: files, least, middle (0-based place n div 2), 90 % (place min(n - 1, int(0.9 n))) and most."""
    per = parent_windows(spark, d).groupBy("doc_id").agg(F.count("*").alias("units")).withColumn("all", F.lit(1))
    ranks = {"median": F.floor(F.col("n") / 2) + 1, "p90": F.least(F.col("n"), F.floor(F.col("n") * 0.9) + 1), "least": F.lit(1), "most": F.col("n")}
    return logs.at_ranks(per, "all", "units", ranks).select(F.col("n").alias("n_files"), "least", "median", "p90", "most")


def leg_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit, reciprocal rank and precision of three legs of retrieval over the same questions."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    index = lexical.Index.of(docs, carry=("source",))
    top = checkpointed(lexical.search(index, items, 15))
    sources = lookup.named(docs.select("doc_id", "source"), top, "doc_id")
    legs = {
        "lexical": top,
        "diversified": fusion.diversified(top.join(sources, "doc_id"), "item_id", "source"),
        "best_of_source": lexical.ranked(lexical.search(index, items, 1, within="source").drop("rank"), "item_id", "doc_id", k=5),
    }
    truth = checkpointed(review.answers(index, docs, items))
    asked = items.select(F.col("item_id").alias("q"))
    named = lambda x: x.select(F.col("item_id").alias("q"), F.col("doc_id").alias("id"), "rank")
    return reduce(DataFrame.unionByName, [rules.retrieval_metrics(asked, named(x), truth).withColumn("leg", F.lit(leg)) for leg, x in legs.items()])


def slowest(spark: SparkSession, d: str) -> DataFrame:
    """Per user the event of the highest value among those that have one, and samples, mean and maximum; null where none has."""
    rows = table(spark, d, "events").withColumn("ms", F.when(F.col("event_type") != "error", F.col("value")))
    worst = F.max(F.when(F.col("ms").isNotNull(), F.struct("ms", (-F.col("event_id")).alias("minus"), "event_id")))
    per = rows.groupBy("user_id").agg(worst.alias("x"), F.count("ms").alias("samples"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.max("ms").alias("max_ms"))
    return per.select("user_id", F.col("x.event_id").alias("slowest"), "samples", "avg_ms", "max_ms")


def recent_requests(spark: SparkSession, d: str) -> DataFrame:
    """The last sixty events of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, d, "events").withColumn("nth", F.row_number().over(w)).where("nth <= 60")
    return rows.select("event_type", F.col("nth").cast("int").alias("nth"), "event_id", "value")


QUERIES = {
    "import_edges": (import_edges, f"WITH {_imports_sql()}{EDGES} SELECT source, target FROM e"),
    "import_graph": (import_graph, f"""WITH {_imports_sql()}{EDGES}, o AS (SELECT source AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT target AS id, count(*) AS n FROM e GROUP BY 1)
        SELECT language, count(*) AS n_files, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS n_out, CAST(sum(coalesce(i.n, 0)) AS BIGINT) AS n_in, count(*) FILTER (o.n IS NULL AND i.n IS NULL) AS isolated
        FROM files f LEFT JOIN o ON o.id = f.id LEFT JOIN i ON i.id = f.id GROUP BY language"""),
    "import_hubs": (import_hubs, f"""WITH {_imports_sql()}{EDGES}, x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e), g AS (SELECT id, count(*) AS n FROM x GROUP BY id)
        SELECT id, name AS label, coalesce(n, 0) AS degree FROM files LEFT JOIN g USING (id) ORDER BY coalesce(n, 0) DESC, name, id LIMIT 30"""),
    "import_reach": (import_reach, f"""WITH RECURSIVE {_imports_sql()}{EDGES}, t AS (SELECT id FROM files WHERE name IN ('nation_0', 'nation_5', 'part_1')),
        r AS (SELECT id AS target, id, 0 AS depth FROM t UNION SELECT r.target, e.source, r.depth + 1 FROM r JOIN e ON e.target = r.id WHERE r.depth < 4)
        SELECT target, id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE id <> target GROUP BY target, id"""),
    "file_chunks": (file_chunks, f"""WITH {FILES}, w AS (SELECT id, text, unnest(range(0, length(text), 50)) AS s FROM files WHERE length(text) > 0), k AS (SELECT * FROM w WHERE s = 0 OR s - 50 + 60 < length(text))
        SELECT id, count(*) AS chunk_count, CAST(max(CASE WHEN s = 0 THEN len(regexp_extract_all(substr(text, 1, 60), '(?m)^(?:import|from|use|const) ')) END) AS INTEGER) AS first_imports FROM k GROUP BY id"""),
    "batch_context": (batch_context, rf"""WITH {_imports_sql()}, {BATCHES}, g AS (SELECT source, min(id) AS target FROM imports JOIN b ON name = stem AND id <> source GROUP BY source, stem),
        e AS (SELECT DISTINCT source, target FROM g JOIN b x ON x.id = source JOIN b y ON y.id = target WHERE x.batch = y.batch),
        o AS (SELECT source AS id, array_to_string(list_sort(list(target))[1:10], ',') AS imports FROM e GROUP BY 1), i AS (SELECT target AS id, array_to_string(list_sort(list(source))[1:10], ',') AS used_by FROM e GROUP BY 1)
        SELECT b.id, batch, array_to_string(regexp_extract_all(text, '(?m)^(?:def|class)[ \t]+(\w+)', 1)[1:20], ',') AS exports, coalesce(imports, '') AS imports, coalesce(used_by, '') AS used_by FROM b LEFT JOIN o ON o.id = b.id LEFT JOIN i ON i.id = b.id"""),
    "batch_import_map": (batch_import_map, f"""WITH {_imports_sql()}, {BATCHES}
        SELECT source, x.batch, count(DISTINCT y.name) AS n_names FROM imports JOIN b x ON x.id = source JOIN b y ON y.batch = x.batch AND starts_with(y.name, stem) WHERE stem <> '' GROUP BY 1, 2"""),
    "quoted_comments": (quoted_comments, f"WITH {REVIEW} SELECT doc_id, name AS file, 1 AS line, 'why?' AS comment FROM src WHERE doc_id % 3 <> 0"),
    "claims_found": (claims_found, f"""WITH {REVIEW}, x AS (SELECT doc_id, name, doc_id % 90 + 1 AS line FROM src)
        SELECT doc_id, 0 AS nth, name AS file, name || ':2-4' AS label FROM x UNION ALL SELECT doc_id, 1, name, name || ':' || line FROM x"""),
    "review_marks": (review_marks, f"WITH {REVIEW} SELECT doc_id, 'NOTE' AS kind, 'ok' AS body FROM src"),
    "review_sections": (review_sections, f"WITH {REVIEW} SELECT doc_id, name AS file, 'fine' AS body, doc_id AS owner, true AS exact FROM src UNION ALL SELECT doc_id, 'src/' || name, 'bad', doc_id, false FROM src"),
    "manifests": (manifests, """WITH s AS (SELECT s_suppkey, 'lib' || s_suppkey AS n, s_suppkey % 9 AS v FROM supplier)
        SELECT s_suppkey, 'pip' AS ecosystem, n AS name, v || '.2' AS version FROM s UNION ALL SELECT s_suppkey, 'pip', 'other', NULL FROM s UNION ALL SELECT s_suppkey, 'npm', n, v || '.1.0' FROM s
        UNION ALL SELECT s_suppkey, 'npm', 'jest', NULL FROM s UNION ALL SELECT s_suppkey, 'go', 'github.com/a/' || n, '1.' || v || '.0' FROM s UNION ALL SELECT s_suppkey, 'go', 'golang.org/x/net', '0.1.2' FROM s"""),
    "parent_windows": (parent_windows, f"WITH {CHILDREN} SELECT * FROM children"),
    "parent_expansion": (parent_expansion, f"""WITH {BM25_SQL}, {CHILDREN}, k AS (SELECT doc_id, count(*) AS n_children FROM children GROUP BY doc_id)
        SELECT item_id, doc_id, rank, md5(text) AS parent_md5, n_children FROM top JOIN documents USING (doc_id) JOIN k USING (doc_id) WHERE rank <= 10"""),
    "chunk_joined": (chunk_joined, """WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text), 1), 810)) AS s FROM documents WHERE text IS NOT NULL),
        k AS (SELECT * FROM w WHERE n > 0 AND (s = 0 OR s - 810 + 900 < n)), j AS (SELECT doc_id, count(*) AS n, string_agg(substr(text, s + 1, 900), chr(10) ORDER BY s) AS t FROM k GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(j.n, 0) AS INTEGER) AS n_chunks, md5(coalesce(t, '')) AS joined_md5 FROM documents d LEFT JOIN j USING (doc_id) WHERE d.text IS NOT NULL"""),
    "metadata_filter": (metadata_filter, "SELECT doc_id, lang, source FROM documents WHERE (lang IN ('fr', 'de') OR contains(source, 'rc1')) AND contains(text, 'e')"),
    "units_per_file": (units_per_file, f"""WITH {CHILDREN}, u AS (SELECT doc_id, count(*) AS n FROM children GROUP BY doc_id), l AS (SELECT list_sort(list(n)) AS l FROM u)
        SELECT len(l) AS n_files, l[1] AS least, l[len(l) // 2 + 1] AS median, l[least(len(l), CAST(floor(len(l) * 0.9) AS BIGINT) + 1)] AS p90, l[len(l)] AS most FROM l"""),
    "leg_metrics": (leg_metrics, rf"""WITH {BM25_SQL}, {review.ANSWERS},
        dv AS (SELECT item_id, doc_id, rank, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS nth FROM top JOIN tk USING (doc_id) WHERE rank <= 15),
        bs AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS nth FROM top JOIN tk USING (doc_id)),
        legs AS (SELECT 'lexical' AS leg, item_id, doc_id, rank FROM top UNION ALL SELECT 'diversified', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) FROM dv WHERE nth <= 2
            UNION ALL SELECT 'best_of_source', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) FROM bs WHERE nth = 1),
        g AS (SELECT leg, item_id, min(rank) AS first, count(*) AS n FROM legs JOIN truth USING (item_id, doc_id) WHERE rank <= 5 GROUP BY leg, item_id), a3 AS (SELECT DISTINCT leg FROM legs)
        SELECT leg, count(*) AS n_queries, round(100 * avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 4) AS hit_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(100 * avg(coalesce(n, 0) / 5), 4) AS precision_at_k
        FROM (SELECT leg, item_id FROM a3, benchmark) LEFT JOIN g USING (leg, item_id) GROUP BY leg"""),
    "slowest": (slowest, """WITH r AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS ms FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC NULLS LAST, event_id) AS nth FROM r)
        SELECT user_id, max(CASE WHEN nth = 1 AND ms IS NOT NULL THEN event_id END) AS slowest, count(ms) AS samples, round(avg(ms), 4) AS avg_ms, max(ms) AS max_ms FROM n GROUP BY user_id"""),
    "recent_requests": (recent_requests, "SELECT event_type, CAST(nth AS INTEGER) AS nth, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 60"),
}
