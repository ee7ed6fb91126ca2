"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of their docs. None of it can be stated in SQL as a whole, so ORACLE_SQL is None and the tests hold it
against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, language, neardup, packing, secrets
from loomspark.session import checkpointed
from loomspark.sources.tables import table

#: A document whose likeliest language has less than this share of the tempered probability is rejected; four languages
#: that are equally likely have 0.25 each.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that no language explains, go."""
    found = language.identified(docs, language.fitted_on(docs), "__lang", "__score")
    return found.where((F.col("__lang") != language.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; all documents stay, and n_chars follows the text."""
    # The spans are written before texts are cut by them, so that both uses below don't search the texts again.
    found = checkpointed(secrets.scanned(docs, "__base", "__every"))
    new = found.withColumn("text", secrets.redacted(F.col("text"), F.col("__every")))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        new = new.withColumn("n_chars", F.when(F.size("__every") > 0, n_chars).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, documents beside those they resemble."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the checkpoint folder for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else checkpointed(docs)
    return docs
