"""Line rules, secret shapes, diffs, triage, review plans, risk and policy decisions, and measures of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (rule, severity, pattern), the first that fits a line names it.
LINE_RULES = (
    ("possible-secret", "high", r"""(?i)(api[_-]?key|secret|passwd|password|token)\s*[:=]\s*['"][^'"]{3,}['"]"""),
    ("eval-exec", "high", r"(?i)\b(eval|exec)\s*\("),
    ("shell-execution", "medium", r"(?i)(subprocess\.(run|Popen|call)|os\.system|child_process\.exec|shell\s*=\s*True)"),
    ("unsafe-deserialization", "medium", r"(?i)(pickle\.loads?|yaml\.load\s*\(|Function\s*\()"),
    ("sql-concatenation", "medium", r"""(?i)(select|insert|update|delete)\b.*(\+|f['"]|\.format\()"""),
    ("broad-except", "low", r"^\s*except\s*(Exception|BaseException)?\s*:\s*(pass\s*)?$"),
    ("debug-print", "low", r"^\s*(print\s*\(|console\.(log|debug|info)\s*\()"),
    ("todo-fixme", "low", r"(?i)\b(TODO|FIXME|HACK|XXX)\b"),
)
#: Key shapes by what they are.
KEY_SHAPES = (
    ("aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github-token", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("github-fine-grained", r"\bgithub_pat_[A-Za-z0-9_]{60,}\b"),
    ("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("openai-style", r"\bsk-[A-Za-z0-9]{32,}\b"),
    ("private-key", r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"),
    ("google-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
)
#: A name that says secret beside a quoted value, and values that only stand for one.
SECRET_ASSIGN = r"""(?i)\b(api[_-]?key|apikey|secret|password|passwd|token|access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token)\b\s*[:=]\s*["'`]([^"'`\n]{8,})["'`]"""
PLACEHOLDER = r"(?i)^\s*(none|null|changeme|placeholder|dummy|example|sample|test|fake|xxx+|\.\.\.|your[-_ ].*|<.*>|\{\{.*\}\}|\$\{.*\}|%[sd]|sk-(test|ci|xxx).*|process\.env\..*|import\.meta\.env\..*|os\.getenv.*)\s*$"
#: Categories of the repository scan.
CATEGORIES = (
    ("hardcoded_secrets", r"""(?i)\b(api_?key|password|secret|private_?key)\s*=\s*["'][^"']{4,}["']"""),
    ("shell_exec", r"\b(subprocess\.(run|call|Popen|check_output)|os\.system|os\.popen)\s*\("),
    ("dangerous_eval", r"\b(eval|exec)\s*\("),
    ("sql_injection", r"""\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\b.*(%s|\{|\+|format\s*\(|f")"""),
    ("deserialization", r"\b(pickle\.loads?|yaml\.load\s*\(|marshal\.loads?)\s*\("),
    ("path_traversal", r"(?i)(\.\.\/|\.\.\\|os\.path\.join.*request|open\s*\(.*request)"),
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Languages that are code, words that raise a file's score in its name and in its text, and kinds that lower it.
CODE = ("py", "js", "jsx", "ts", "tsx", "go", "java", "rs", "rb")
NAME_WORDS = ("auth", "security", "api", "service", "agent", "retriev", "ingest")
TEXT_WORDS = ("password", "token", "secret", "subprocess", "sql", "exec(")
PLAIN_KINDS = ("json", "yaml", "yml", "md", "txt")


def lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (1-based), body of every line of every text."""
    return rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "body")).select(key, (F.col("at") + 1).alias("line"), "body")


def line_findings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, rule, severity: the first rule that fits each line."""
    fit = None
    for rule, severity, pattern in LINE_RULES:
        found = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
        fit = F.when(F.col("body").rlike(pattern), found) if fit is None else fit.when(F.col("body").rlike(pattern), found)
    return lines(rows, key, text).withColumn("fit", fit).where("fit is not null").select(key, "line", "fit.rule", "fit.severity")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(5 - F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)) + 1, F.lit(0)).cast("int")


def secret_assignments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, name of quoted values under a secret's name; placeholders are left out."""
    body = lines(rows, key, text).where(F.col("body").rlike(SECRET_ASSIGN))
    named = body.select(key, "line", F.lower(F.regexp_extract("body", SECRET_ASSIGN, 1)).alias("name"), F.regexp_extract("body", SECRET_ASSIGN, 2).alias("value"))
    return named.where(~F.col("value").rlike(PLACEHOLDER)).drop("value")


def added_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """key, path, line, body of the lines that unified diffs add, numbered as in the new file."""
    w = Window.partitionBy(key).orderBy("at")
    rows = diffs.select(key, F.posexplode(F.split(diff, "\n")).alias("at", "raw"))
    start = F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    rows = rows.withColumn("path", F.last(F.when(F.col("raw").startswith("+++ "), F.regexp_extract("raw", r"^\+\+\+ (?:b/)?(.*)$", 1)), True).over(w))
    rows = rows.withColumn("hunk", F.sum(F.when(start != "", 1).otherwise(0)).over(w)).withColumn("begin", F.last(F.when(start != "", start.cast("int")), True).over(w))
    inside = rows.where((F.col("hunk") > 0) & ~F.col("raw").rlike(r"^(@@|\+\+\+ |--- |diff |\\)"))
    counted = inside.withColumn("nth", F.sum(F.when(F.col("raw").startswith("-"), 0).otherwise(1)).over(Window.partitionBy(key, "hunk").orderBy("at")))
    return counted.where(F.col("raw").startswith("+")).select(key, "path", (F.col("begin") + F.col("nth") - 1).cast("int").alias("line"), F.expr("substring(raw, 2)").alias("body"))


def triage_score(name: Column, language: Column, content: Column) -> Column:
    """How much a file deserves a review."""
    has = lambda c, words: c.rlike("|".join(w.replace("(", r"\(") for w in words))
    name, language, low = F.lower(name), F.lower(language), F.lower(content)
    code = language.isin(*CODE)
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        1 + add((F.length(content) < 100) & ~code, -8) + add(code, 4)
        + add(has(name, NAME_WORDS), 3)
        + add(has(low, TEXT_WORDS), 3)
        + add(name.endswith("lock") | name.contains("package-lock"), -5) + add(language.isin(*PLAIN_KINDS), -2)
    )


def review_plan(files: DataFrame, budget: int = 6, batch: int = 4, least: int = 3) -> DataFrame:
    """files (repo, id, score, size, strong, static) with kind and batch, planned per repo.

    static files need no reader. Of the others, strong ones or those of score 6 are read singly while the budget lasts, highest score and
    size first; the rest go in batches in the order of ids, and a last batch of fewer than ``least`` is read singly.
    """
    best = Window.partitionBy("repo", "eligible").orderBy(F.desc("score"), F.desc("size"), F.desc("id"))
    rows = files.withColumn("eligible", ~F.col("static") & (F.col("strong") | (F.col("score") >= 6))).withColumn("nth", F.row_number().over(best))
    rows = rows.withColumn("pool", F.when(F.col("static"), "static").when(F.col("eligible") & (F.col("nth") <= budget), "single").otherwise("batch"))
    place = F.row_number().over(Window.partitionBy("repo", "pool").orderBy("id")) - 1
    rows = rows.withColumn("group", F.floor(place / batch).cast("int"))
    size = F.count("*").over(Window.partitionBy("repo", "pool", "group"))
    kind = F.when((F.col("pool") == "batch") & (F.col("members") < least), "single").otherwise(F.col("pool"))
    rows = rows.withColumn("members", size).withColumn("kind", kind)
    return rows.select("repo", "id", "score", "kind", F.when(F.col("kind") == "batch", F.col("group")).alias("batch"))


def risk(parts: list[Column]) -> Column:
    """The parts' sum, 10 at most."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(10), total)


def risk_level(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")


def decision(score: Column, verified: Column, token: Column, reason: Column, approval: int = 6, block: int = 10) -> Column:
    """blocked without verification or at the block score; from the approval score on allowed with a token and a reason of 8 characters."""
    given = token.isNotNull() & (F.length(F.trim(F.coalesce(reason, F.lit("")))) >= 8)
    return F.when(~verified, "blocked").when(score >= block, "blocked").when((score >= approval) & ~given, "needs_approval").otherwise("allowed")


def detection(rows: DataFrame, by: str, flagged: Column, truth: Column) -> DataFrame:
    """Per group tp, fp, fn, tn, precision, recall, f1 (4 decimals; null where nothing is to divide by)."""
    n = lambda a, b: F.count_if(a & b)
    out = rows.groupBy(by).agg(n(flagged, truth).alias("tp"), n(flagged, ~truth).alias("fp"), n(~flagged, truth).alias("fn"), n(~flagged, ~truth).alias("tn"))
    div = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    return out.select("*", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def retrieval_metrics(queries: DataFrame, ranked: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """One row: n_queries, hit_at_k (percent), mrr, precision_at_k (percent). queries (q), ranked (q, id, rank), truth (q, id).
    A query that nothing answers stays in the denominator."""
    good = ranked.where(F.col("rank") <= k).join(truth.distinct(), ["q", "id"]).groupBy("q").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    rows = queries.select("q").distinct().join(good, "q", "left")
    return rows.agg(
        F.count("*").alias("n_queries"), F.round(100 * F.avg(F.when(F.col("first").isNotNull(), 1).otherwise(0)), 4).alias("hit_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(100 * F.avg(F.coalesce(F.col("n"), F.lit(0)) / k), 4).alias("precision_at_k"),
    )


def citations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of retrieved chunks (rank, start_line, end_line, score, symbol): span, count, best score and its trust,
    symbol of the best chunk that has one, rank of the first."""
    out = rows.groupBy(*by).agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("chunk_count"), F.max("score").alias("score"),
        F.max_by("symbol", F.when(F.col("symbol") != "", F.struct("score", -F.col("rank")))).alias("symbol"), F.min("rank").alias("first_rank"),
    )
    trust = F.when(F.col("score").isNull(), "unrated").when(F.col("score") >= 2, "high").when(F.col("score") >= -3, "medium").otherwise("low")
    return out.withColumn("trust", trust)


def grounded(claims: DataFrame, served: DataFrame, bin_size: int = 64) -> DataFrame:
    """claims (file, start, end) with verdict: not_in_context, outside_range or matched against served (file, low, high).

    Served spans are cut into bins of lines, and a claim looks into the bin of its start alone: a file that is served
    often and claimed often isn't held against itself. Spans that hold no line match nothing.
    """
    bins = F.sequence(F.floor(F.col("low") / bin_size), F.floor(F.col("high") / bin_size))
    spans = served.where("low <= high").select("file", "low", "high").distinct().select("file", "low", "high", F.explode(bins).alias("bin"))
    starts = claims.select("file", "start").distinct().withColumn("bin", F.floor(F.col("start") / bin_size))
    inside = starts.join(spans, ["file", "bin"]).where((F.col("low") <= F.col("start")) & (F.col("start") <= F.col("high")))
    inside = inside.select("file", "start").distinct().withColumn("inside", F.lit(True))
    known = served.select("file").distinct().withColumn("known", F.lit(True))
    rows = claims.join(known, "file", "left").join(inside, ["file", "start"], "left")
    verdict = F.when(F.col("known").isNull(), "not_in_context").when(F.col("inside"), "matched").otherwise("outside_range")
    return rows.select(*claims.columns, verdict.alias("verdict"))
