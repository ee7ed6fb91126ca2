"""What a question asks for: intent, scope, variants, and fallbacks where a filter leaves nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keywords of each intent, in the order that breaks ties.
INTENTS = {
    "security": ("auth", "authentication", "authoriz", "login", "logout", "session", "jwt", "token", "password", "secret", "api key", "api_key", "injection", "xss", "csrf", "sql inject", "vulnerability", "exploit", "sanitiz", "escape", "hashing", "bcrypt", "oauth", "rbac", "permission", "cors", "rate limit"),
    "tests": ("test", "spec", "unit test", "integration test", "pytest", "jest", "fixture", "mock", "assert", "coverage", "conftest"),
    "config": ("config", "configuration", "setting", "environment", ".env", "dotenv", "docker", "compose", "yaml", "yml", "json config", "secret key", "deploy", "railway", "vercel", "ci/cd", "github action", "workflow"),
    "api": ("endpoint", "route", "router", "controller", "handler", "http", "get request", "post request", "rest api", "fastapi", "express", "middleware", "request", "response", "status code", "webhook"),
}
#: Words that are added to a question that holds one of them.
SYNONYMS = (
    ("auth", "authentication", "authorization", "login", "token"),
    ("error", "exception", "failure", "retry", "handling"),
    ("database", "db", "sql", "query", "repository"),
    ("dependency", "import", "module", "package"),
    ("config", "configuration", "settings", "environment"),
)
#: Fixed patterns: a file named by @, and an identifier with its dots.
SCOPE = r"@([A-Za-z0-9_\-\./\\]+)"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def intent(question: Column) -> Column:
    """The intent with most keywords in the question; the first named of equals; general if none is there."""
    low = F.lower(F.coalesce(question, F.lit("")))
    hits = {name: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for name, words in INTENTS.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, "general")
    for name, n in hits.items():
        out = out.when(n == best, name)
    return out


def scope(question: Column) -> tuple[Column, Column]:
    """The question without its first @file, and that file or null; a question of nothing else stays as it is."""
    whole, name = F.regexp_extract(question, SCOPE, 0), F.regexp_extract(question, SCOPE, 1)
    rest = F.trim(F.replace(question, whole, F.lit("")))
    return F.when((whole != "") & (rest != ""), rest).otherwise(question), F.when(whole != "", name)


def variants(question: Column, most: int = 3) -> Column:
    """Up to three distinct spellings: as asked, identifiers alone, with the first group of synonyms that it touches."""
    low = F.lower(question)
    names = F.array_join(F.regexp_extract_all(question, F.lit(IDENTIFIER), F.lit(0)), " ")
    wide = None
    for group in SYNONYMS:
        touched = F.array(*[low.contains(w) for w in group])
        more = F.concat(question, F.lit(" " + " ".join(group)))
        hit = F.exists(touched, lambda b: b)
        wide = F.when(hit, more) if wide is None else wide.when(hit, more)
    return F.slice(F.array_distinct(F.filter(F.array(question, F.when(names != "", names), wide), lambda x: x.isNotNull())), 1, most)


def scoped_or_all(rows: DataFrame, by: str, match: Column) -> DataFrame:
    """The rows of each ``by`` that match; all of them, with fell_back true, where none does."""
    n = F.sum(F.when(match, 1).otherwise(0)).over(Window.partitionBy(by))
    return rows.withColumn("__n", n).where(match | (F.col("__n") == 0)).withColumn("fell_back", F.col("__n") == 0).drop("__n")


def diagnosis(n_indexed: Column, n_candidates: Column, kept: Column, n_sources: Column, of_intent: Column) -> Column:
    """P10 for an empty index, P05 or P01 for no candidates, P08 if three or more rows come from one source, else null."""
    return (
        F.when(n_indexed == 0, "P10")
        .when((n_candidates == 0) & (of_intent != "general"), "P05")
        .when(n_candidates == 0, "P01")
        .when((kept >= 3) & (n_sources == 1), "P08")
    )


def condition(spec: dict) -> Column:
    """A filter over columns from a nested description: {"lang": "en"}, {"source": {"$in": [...]}}, {"name": {"$contains": part}},
    {"$and": [...]}, {"$or": [...]}; several keys of one mapping hold together. An empty mapping holds for every row.

    The result is a column expression, so that it reaches the scan; a null value fits nothing."""
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            join = Column.__and__ if key == "$and" else Column.__or__
            parts.append(reduce(join, [condition(x) for x in value], F.lit(key == "$and")))
        elif isinstance(value, dict):
            (how, wanted), = value.items()
            if how not in ("$eq", "$in", "$contains"):
                raise ValueError(f"unknown filter {how}")
            parts.append(F.col(key).isin(wanted) if how == "$in" else F.contains(F.col(key), F.lit(wanted)) if how == "$contains" else F.col(key) == wanted)
        else:
            parts.append(F.col(key) == value)
    return reduce(Column.__and__, parts, F.lit(True))
