"""The thin queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontam, language, licences, neardup, negatives, packing, phrases, pii, quality, repeats, secrets, sharding, urls
from loomspark.sources.tables import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs.select("doc_id", "text"), language.fitted_on(docs))
    return found.select("doc_id", (language.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _op9_sql() -> str:
    """The host rules, and the globs as patterns of SIMILAR meaning over the canonical URL."""
    whole = "lower(regexp_extract(url, '^(.*?)://', 1)) || '://' || host || regexp_replace(substr(url, strpos(url, '://') + 3 + length(host)), '#.*$', '')"
    globs = " OR ".join(f"canon GLOB '{g}'" for g in urls.BLOCK_GLOBS)
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(urls.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    return f"""
    WITH a AS (SELECT page_id, coalesce(url, '') AS url, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) AS host,
                      regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    b AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN {whole} ELSE url END AS canon FROM a)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM b"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)],
        F.sha2(secrets.as_text(F.col("base_found")), 256).alias("base_sha256"),
        secrets.as_text(F.col("all_found")).alias("spans"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.balanced(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keeps")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), label=label)


_OP11_SQL = """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
          FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
    WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op13_phrase_mining": (op13_phrase_mining, phrases.duckdb_sql()),
    "op12_substring_dedup": (op12_substring_dedup, repeats.duckdb_sql()),
    "op11_hard_negatives": (op11_hard_negatives, _OP11_SQL),
    "op4_minhash_dedup": (op4_minhash_dedup, None),
    "op8_sharding": (op8_sharding, None),
    "op6_packing": (op6_packing, None),
    "op2_decontamination": (op2_decontamination, decontam.duckdb_sql()),
    "op1_license_scan": (op1_license_scan, licences.duckdb_sql()),
    "op5_pii_pseudonyms": (op5_pii_pseudonyms, None),
    "op10_secret_scan": (op10_secret_scan, None),
    "op7_language_id": (op7_language_id, None),
    "op9_url_filters": (op9_url_filters, _op9_sql()),
    "op3_quality_rules": (op3_quality_rules, None),
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = (pipeline, None)


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
