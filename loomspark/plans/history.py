"""Blame and listings of trees: the documents as files with commits, written as git prints them and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import history
from loomspark.sources.tables import table

#: Each file has runs of RUN lines of one commit, which come again after COMMITS runs; OWNERS groups of files share commits.
RUN, COMMITS, OWNERS = 3, 4, 51


def porcelain(docs: DataFrame) -> DataFrame:
    """doc_id, text: the blame of each document. A commit is told of at its first line in a file alone."""
    line = F.struct(F.col("doc_id").alias("d"), F.split("text", "\n").alias("ls"))

    def record(d, x, i):
        run = F.floor(i / RUN)
        c = d % OWNERS * COMMITS + run % COMMITS
        told = F.concat(F.lit("author dev "), c % 17, F.lit("\nauthor-mail <dev@example.com>\nauthor-time "), c * 86_400 + 1_600_000_000, F.lit("\nsummary part of "), c, F.lit("\n"))
        first = F.concat(F.lit(f" {RUN}\n"), F.when((i % RUN == 0) & (run < COMMITS), told).otherwise(F.lit("")))
        return F.concat(F.sha1(c.cast("string").cast("binary")), F.lit(" "), i + 1, F.lit(" "), i + 1, F.when(i % RUN == 0, first).otherwise(F.lit("\n")), F.lit("\t"), x, F.lit("\n"))

    whole = F.transform(F.array(line), lambda v: F.array_join(F.transform(v["ls"], lambda x, i: record(v["d"], x, i)), ""))
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.get(whole, F.lit(0)).alias("text"))


def blame_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document with the commit that changed it last."""
    found = history.blamed(porcelain(table(spark, d, "documents")), "doc_id")
    return found.select("doc_id", "line_no", "short_sha", "author", "date", F.md5("content").alias("content_md5"))


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """What is meant by whole paths, ends of paths, base names under other folders, and names that aren't there: a document is a
    file, several of which share a name."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("none")).alias("s"), F.coalesce("lang", F.lit("und")).alias("l"))
    name = F.concat(F.lit("d"), F.col("doc_id") % 500, F.lit(".txt"))
    line = F.concat(F.lit("100644 blob "), F.sha1(F.col("doc_id").cast("string").cast("binary")), F.lpad(F.col("doc_id").cast("string"), 8, " "), F.lit("\t"), F.concat_ws("/", "s", "l", name))
    tree = history.listed(docs.select(line.alias("value")))
    kind = F.col("doc_id") % 4
    rel = F.when(kind == 0, F.concat_ws("/", "s", "l", name)).when(kind == 1, F.concat_ws("/", "l", name)).when(kind == 2, F.concat(F.lit("old/place/"), name)).otherwise(F.concat(F.lit("gone/x"), name))
    return history.resolved(docs.select("doc_id", rel.alias("rel")), tree)


QUERIES = {
    "blame_lines": (blame_lines, f"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        c AS (SELECT *, doc_id % {OWNERS} * {COMMITS} + (i - 1) // {RUN} % {COMMITS} AS c FROM l)
        SELECT doc_id, CAST(i AS BIGINT) AS line_no, left(sha1(CAST(c AS VARCHAR)), 7) AS short_sha, 'dev ' || c % 17 AS author,
            strftime(to_timestamp(c * 86400 + 1600000000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, md5(x) AS content_md5 FROM c"""),
    "tree_paths": (tree_paths, """
        WITH d AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/d' || doc_id % 500 || '.txt' AS path, coalesce(lang, 'und') AS l, 'd' || doc_id % 500 || '.txt' AS name
            FROM documents WHERE doc_id IS NOT NULL),
        a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN path WHEN 1 THEN l || '/' || name WHEN 2 THEN 'old/place/' || name ELSE 'gone/x' || name END AS rel, name FROM d),
        t AS (SELECT DISTINCT path, split_part(path, '/', -1) AS name FROM d),
        r AS (SELECT DISTINCT rel, CASE WHEN rel LIKE 'gone/%' THEN NULL ELSE name END AS name FROM a),
        m AS (SELECT rel, path, CASE WHEN path = rel THEN 0 WHEN ends_with(path, '/' || rel) THEN 1 ELSE 2 END AS how FROM r JOIN t USING (name)),
        b AS (SELECT rel, path FROM m QUALIFY row_number() OVER (PARTITION BY rel ORDER BY how, length(path), path) = 1)
        SELECT doc_id, a.rel, b.path AS resolved FROM a LEFT JOIN b USING (rel)"""),
}
