"""Sources: trees of files, JSON lines, JSON documents, delimited logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.encodings import decoded
from loomspark.functions.text import extension

#: Folders that are never read, and the kinds of file that are.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next")
KINDS = ("py", "js", "jsx", "ts", "tsx", "go", "java", "rs", "rb", "md", "txt", "json", "yaml", "yml", "toml", "html", "css", "sql", "sh")


def source_files(spark: SparkSession, root: str, most_bytes: int = 500_000) -> DataFrame:
    """source, file_name, language, size, content_hash, text, encoding of the files below root of a known kind and size. The encoding
    is told from the bytes (see ``functions.encodings``), so that UTF-16, Windows and Latin-1 files are kept; those that hold no
    text (binary) are left out. The size and path are tested before a file's content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") < most_bytes)
    hidden = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    rows = rows.where(~F.col("path").rlike(hidden)).withColumn("language", extension(F.col("path"))).where(F.col("language").isin(*KINDS))
    rows = rows.withColumn("read", decoded(F.col("content")))
    return rows.select(
        F.col("path").alias("source"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "language", F.col("length").alias("size"),
        F.left(F.sha2("content", 256), F.lit(16)).alias("content_hash"), "read.text", "read.encoding",
    ).where("text is not null")


def json_lines(spark: SparkSession, path: str, schema: str, last: int | None = None, order: str = "ts") -> DataFrame:
    """Rows of a JSON-lines log without its broken lines; the last ones by ``order`` if asked for."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc(order)).limit(last) if last else rows


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document over many lines as one row."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """sha, author, date, subject of a log written with the unit separator between its fields."""
    parts = F.split("value", "\x1f")
    rows = spark.read.text(path).where(F.size(parts) >= 4)
    return rows.select(*[parts[i].alias(n) for i, n in enumerate(("sha", "author", "date", "subject"))])
