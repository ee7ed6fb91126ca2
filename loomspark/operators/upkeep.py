"""A stored BM25 index that follows its documents: only sources that changed are cut again.

The folder holds versions. A version has the tokens of the documents that it cut (``tokens``), the keys whose older tokens no longer count
(``gone``), signed changes of document frequencies (``changes``) and the digest of each document that it knows (``known``). An index as of a
version is the tokens of all versions that no later one has taken back, and the sum of all changes: what was cut before is read, never
cut again. ``compacted`` writes all of it as one version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.tokens import token_sets
from loomspark.operators.lexical import EPSILON, Index
from loomspark.session import checkpointed


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("\0")), 256)


def _write(rows: DataFrame, folder: str, part: str, version: int) -> None:
    # A version that is written again after a failure replaces what is there of it.
    rows.write.mode("overwrite").parquet(f"{folder}/{part}/version={version}")


def _read(spark: SparkSession, folder: str, part: str, version: int, of: type | None = None) -> DataFrame:
    rows = spark.read.option("basePath", f"{folder}/{part}").parquet(*[f"{folder}/{part}/version={v}" for v in range(version + 1)])
    return rows.withColumn("version", F.col("version").cast("int"))


def start(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> int:
    """The first version: all documents. Keys must be unique and not null."""
    tokens = checkpointed(docs.select(key, *carry, token_sets(F.col(text)).alias("tokens")))
    _write(tokens, folder, "tokens", 0)
    _write(tokens.select(key).where("false"), folder, "gone", 0)
    _write(_frequencies(tokens, 1), folder, "changes", 0)
    _write(docs.select(key, digest(F.col(text)).alias("digest")), folder, "known", 0)
    return 0


def _frequencies(tokens: DataFrame, sign: int) -> DataFrame:
    return tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg((sign * F.count("*")).alias("df"))


def live(spark: SparkSession, folder: str, version: int, key: str = "doc_id") -> DataFrame:
    """The tokens that count at a version: of each key those cut last, unless it went later."""
    tokens = _read(spark, folder, "tokens", version)
    if version == 0:
        return tokens.drop("version")
    # Keys that went at some version: few beside the corpus, one row each.
    last = _read(spark, folder, "gone", version).groupBy(F.col(key).alias("__key")).agg(F.max("version").alias("__at"))
    return tokens.join(last, (F.col(key) == F.col("__key")) & (F.col("version") < F.col("__at")), "left_anti").drop("version")


def plan(docs: DataFrame, folder: str, version: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, action ('new', 'changed', 'removed'): what differs from the documents known at a version; the digests meet in one full join."""
    known = docs.sparkSession.read.parquet(f"{folder}/known/version={version}").select(F.col(key).alias("__key"), F.col("digest").alias("__digest"))
    now = docs.select(key, digest(F.col(text)).alias("digest"))
    both = now.join(known, F.col(key) == F.col("__key"), "full_outer")
    action = F.when(F.col("__key").isNull(), "new").when(F.col(key).isNull(), "removed").when(F.col("digest") != F.col("__digest"), "changed")
    return both.select(F.coalesce(key, "__key").alias(key), action.alias("action")).where("action is not null")


def advance(docs: DataFrame, folder: str, version: int, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> int:
    """The next version, for the documents as they are now: tokens of new and changed ones, keys of changed and removed ones, and what both do
    to the document frequencies."""
    spark = docs.sparkSession
    steps = checkpointed(plan(docs, folder, version, key, text))
    fresh = docs.join(steps.where("action <> 'removed'").select(key), key, "left_semi").select(key, *carry, token_sets(F.col(text)).alias("tokens"))
    fresh = checkpointed(fresh)
    gone = steps.where("action <> 'new'").select(key)
    old = live(spark, folder, version, key).join(gone, key, "left_semi")
    changes = _frequencies(fresh, 1).unionByName(_frequencies(old, -1)).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
    following = version + 1
    _write(changes, folder, "changes", following)
    _write(fresh, folder, "tokens", following)
    _write(gone, folder, "gone", following)
    _write(docs.select(key, digest(F.col(text)).alias("digest")), folder, "known", following)
    return following


def index(spark: SparkSession, folder: str, version: int, key: str = "doc_id") -> Index:
    """The index as of a version, for ``lexical.search``: the same scores as one that is built anew."""
    tokens = live(spark, folder, version, key)
    n = tokens.count()
    held = _read(spark, folder, "changes", version).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    raw = checkpointed(held.select("token", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0  # one number
    return Index(tokens, raw.select("token", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf")).alias("idf")), key)


def compacted(spark: SparkSession, folder: str, version: int, into: str, key: str = "doc_id") -> int:
    """All versions as the first one of another folder."""
    _write(live(spark, folder, version, key), into, "tokens", 0)
    _write(spark.read.parquet(f"{folder}/gone/version={version}").where("false"), into, "gone", 0)
    _write(_read(spark, folder, "changes", version).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0"), into, "changes", 0)
    _write(spark.read.parquet(f"{folder}/known/version={version}"), into, "known", 0)
    return 0
