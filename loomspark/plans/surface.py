"""Queries: events bounded for a stream, a feed of six unlike sources, tools called from SQL, encodings told from bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import bounds, encodings
from loomspark.operators import feed, sqltools
from loomspark.sources.tables import table

#: Characters of a further field of an event.
PART = 150


def bounded_events(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an event of a stream: its text as message, its lines and words as lists, the words of its lines as a
    nested map, and a field for every 150 characters, so that all bounds and passes are met."""
    docs = table(spark, d, "documents").where("text is not null")
    lines, words = F.split("text", "\n"), F.split("text", " ")
    rows = docs.select(
        "doc_id", F.lit("file").alias("step"), F.col("text").alias("message"), F.col("source").alias("tool"), F.col("doc_id").alias("step_id"), F.col("lang").alias("plan_id"),
        lines.alias("lines"), words.alias("words"),
        F.map_from_entries(F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("line_"), i.cast("string")), F.split(x, " ")))).alias("args"),
        F.map_from_entries(F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda x, i: F.struct(F.concat(F.lit("part_"), i.cast("string")), x))).alias("parts"),
    )
    fields = {f.name: (F.col(f.name), f.dataType) for f in rows.schema if f.name not in ("doc_id", "parts")}
    told = rows.select("doc_id", bounds.encoded(fields, F.col("parts")).alias("told"))
    return told.select("doc_id", "told.passes", F.octet_length("told.event").alias("n_bytes"), "told.event")


def _bounded_sql() -> str:
    cut = lambda x, n: f"CASE WHEN length({x}) > {n} THEN left({x}, {n - 1}) || '…' ELSE {x} END"
    items = lambda xs: f"to_json(list_transform(list_slice({xs}, 1, {bounds.LIST}), lambda x: {cut('x', bounds.FIELD)}))"

    def plain(x: str) -> str:
        for m in bounds.MARKS:
            x = f"replace({x}, '__{m}__', '\\u005f_{m}__')"
        return x

    entry = lambda key, json, is_list, text: f"{{'key': '{key}', 'json': {json}, 'list': {is_list}, 'text': {text}}}"
    text = lambda key, col, most: entry(key, f"CAST(to_json({cut(col, most)}) AS VARCHAR)", "false", cut(col, most))
    joined = lambda xs, json: plain(f"'{{' || coalesce(list_aggregate(list_transform({xs}, lambda e: CAST(to_json(e.key) AS VARCHAR) || ': ' || {json}), 'string_agg', ', '), '') || '}}'")
    kept = "e.key IN (" + ", ".join(f"'{k}'" for k in bounds.KEPT) + ")"
    small = f"list_filter(es, lambda e: {kept})"
    short = lambda most: joined(small, f"CAST(to_json({cut('e.text', most)}) AS VARCHAR)")
    return rf"""WITH r AS (SELECT doc_id, text, lang, source, string_split(text, chr(10)) AS lines, string_split(text, ' ') AS words, regexp_extract_all(text, '(?s).{{1,{PART}}}') AS parts FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, list_filter([{text("step", "'file'", bounds.FIELD)}, {text("message", "text", bounds.MESSAGE)},
        CASE WHEN source IS NOT NULL THEN {text("tool", "source", bounds.FIELD)} END, {entry("step_id", "CAST(doc_id AS VARCHAR)", "false", "CAST(doc_id AS VARCHAR)")},
        CASE WHEN lang IS NOT NULL THEN {text("plan_id", "lang", bounds.FIELD)} END,
        {entry("lines", f"CAST({items('lines')} AS VARCHAR)", "true", "''")}, {entry("words", f"CAST({items('words')} AS VARCHAR)", "true", "''")},
        {entry("args", "'{' || list_aggregate(list_transform(range(least(len(lines), " + str(bounds.INNER) + ")), lambda i: '" + '"' + "line_' || i || '" + '"' + ":' || CAST(" + items("string_split(lines[i + 1], ' ')") + " AS VARCHAR)), 'string_agg', ',') || '}'", "false", "''")}], lambda e: e IS NOT NULL)
        || list_transform(range(len(parts)), lambda i: {{'key': 'part_' || i, 'json': CAST(to_json({cut("parts[i + 1]", bounds.FIELD)}) AS VARCHAR), 'list': false, 'text': parts[i + 1]}}) AS es FROM r),
    b AS (SELECT doc_id, CASE WHEN len(es) <= {bounds.FIELDS} THEN es ELSE {small} || list_filter(list_slice(es, 1, {bounds.FIELDS} - len({small})), lambda e: NOT ({kept}))
        || [{{'key': 'fields_dropped', 'json': CAST(len(es) - {bounds.FIELDS} AS VARCHAR), 'list': false, 'text': ''}}] END AS es FROM a),
    p AS (SELECT doc_id, {joined("es", "e.json")} AS p1, {joined("list_filter(es, lambda e: NOT e.list)", "e.json")} AS p2, {short(bounds.FIELD)} AS p3, {short(bounds.SHORTEST)} AS p4 FROM b),
    t AS (SELECT *, CASE WHEN strlen(p1) <= {bounds.BYTES} THEN 1 WHEN strlen(p2) <= {bounds.BYTES} THEN 2 WHEN strlen(p3) <= {bounds.BYTES} THEN 3 ELSE 4 END AS passes FROM p)
    SELECT doc_id, passes, CAST(strlen([p1, p2, p3, p4][passes]) AS INTEGER) AS n_bytes, [p1, p2, p3, p4][passes] AS event FROM t"""


def _six(spark: SparkSession, d: str) -> list[DataFrame]:
    """Clicks with their JSON, orders, shipments, shared questions (their time an ISO text), daily totals, runs (seconds)."""
    events, talks = table(spark, d, "events"), table(spark, d, "conversations")
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    none, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    clicks = feed.source(events.where("event_type = 'click'"), "click", "event_id", "ts", 50, text("event_id"), text("props"), none, "props")
    ordered = orders.select("*", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")).alias("meta"))
    bought = feed.source(ordered, "order", "o_orderkey", "o_orderdate", 50, F.col("o_orderpriority"), text("o_custkey"), F.col("o_orderstatus"), "meta")
    sent = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ts"), F.count("*").alias("n"), F.min("l_returnflag").alias("flag"))
    sent = sent.select("*", F.struct("n", F.struct("flag").alias("state")).alias("meta"))
    shipped = feed.source(sent, "shipment", "l_orderkey", "ts", 50, text("n"), none, F.col("flag"), "meta")
    asked = talks.where("turn = 0").join(events.select(F.col("event_id").alias("conv_id"), text("ts").alias("at")), "conv_id")
    asked = asked.select("*", F.struct("role").alias("meta"))
    shared = feed.source(asked, "share", "conv_id", "at", 20, F.coalesce(F.nullif("text", F.lit("")), F.lit("Shared chat")), F.col("text"), F.lit("share"), "meta")
    days = events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    days = days.select("*", F.date_format("day", "yyyyMMdd").alias("key"), F.to_json(F.struct("n", "errors")).alias("meta"))
    totals = feed.source(days, "analytics", "key", "day", 20, F.concat(F.lit("Day of "), text("n"), F.lit(" events")), F.concat(text("errors"), F.lit(" errors")), F.lit("snapshot"), "meta")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.max("ts").cast("timestamp_ntz"))
    runs = events.groupBy("user_id").agg(seconds.alias("at"), F.count("*").alias("n")).select("*", F.struct("n").alias("meta"))
    ran = feed.source(runs, "run", "user_id", "at", 20, F.concat(F.lit("user "), text("user_id")), text("n"), F.lit("run"), "meta")
    return [clicks, bought, shipped, shared, totals, ran]


def _shown(rows: DataFrame) -> DataFrame:
    """The feed with what its VARIANT holds under the names that some source gives."""
    got = lambda path, kind: F.try_variant_get("meta", path, kind)
    n: Column = F.coalesce(got("$.n", "bigint"), got("$.k", "bigint"))
    return rows.select("kind", "id", "ts", "title", "detail", "sub_kind", n.alias("n"), got("$.status", "string").alias("status"), got("$.state.flag", "string").alias("flag"))


def activity_sources(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 of six sources of unlike shape."""
    return _shown(feed.activity(_six(spark, d), 500))


def activity_of_kind(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 daily totals: rarer and older than all other kinds, found because the kind is tested before the limit."""
    return _shown(feed.activity(_six(spark, d), 50, " Analytics"))


_FEED = """click AS (SELECT 'click' AS kind, 'click-' || event_id AS id, ts, CAST(event_id AS VARCHAR) AS title, left(props, 200) AS detail, NULL::VARCHAR AS sub_kind, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) AS n, NULL::VARCHAR AS status, NULL::VARCHAR AS flag
        FROM events WHERE event_type = 'click' AND ts IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 50),
    bought AS (SELECT 'order', 'order-' || o_orderkey AS id, o_orderdate AS ts, left(o_orderpriority, 80), CAST(o_custkey AS VARCHAR), o_orderstatus, NULL::BIGINT, o_orderstatus, NULL FROM orders WHERE o_orderdate IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 50),
    sent AS (SELECT 'shipment', 'shipment-' || l_orderkey AS id, max(l_shipdate) AS ts, CAST(count(*) AS VARCHAR), NULL::VARCHAR, min(l_returnflag), count(*), NULL, min(l_returnflag) FROM lineitem GROUP BY l_orderkey HAVING max(l_shipdate) IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 50),
    shared AS (SELECT 'share', 'share-' || conv_id AS id, ts, left(coalesce(nullif(text, ''), 'Shared chat'), 80), left(text, 200), 'share', NULL::BIGINT, NULL, NULL FROM conversations JOIN events ON event_id = conv_id WHERE turn = 0 AND ts IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 20),
    totals AS (SELECT 'analytics', 'analytics-' || strftime(date_trunc('day', ts), '%Y%m%d') AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, 'Day of ' || count(*) || ' events', CAST(count(*) FILTER (event_type = 'error') AS VARCHAR) || ' errors', 'snapshot', count(*), NULL, NULL FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('day', ts) ORDER BY day DESC LIMIT 20),
    ran AS (SELECT 'run', 'run-' || user_id AS id, date_trunc('second', max(ts)) AS seen, 'user ' || user_id, CAST(count(*) AS VARCHAR), 'run', count(*), NULL, NULL FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING max(ts) IS NOT NULL ORDER BY seen DESC, id DESC LIMIT 20),
    f AS (SELECT * FROM click UNION ALL SELECT * FROM bought UNION ALL SELECT * FROM sent UNION ALL SELECT * FROM shared UNION ALL SELECT * FROM totals UNION ALL SELECT * FROM ran)"""  # fmt: skip

#: What is searched for: words of several languages that end a line, and numbers.
SOUGHT = r"(^| )(the|les|der|el) [^\n]{0,40}[.,]\s*$|[0-9]{2,}"


def _viewed(spark: SparkSession, d: str) -> SparkSession:
    table(spark, d, "documents").createOrReplaceTempView("searched_documents")
    return sqltools.registered(spark)


def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    """search_pattern from SQL over every document: the first 30 lines that match, with numbers."""
    return _viewed(spark, d).sql(
        "SELECT doc_id, line, md5(shown) AS shown_md5 FROM searched_documents, LATERAL search_pattern(text, :sought)", args={"sought": SOUGHT}
    )


def tool_counts(spark: SparkSession, d: str) -> DataFrame:
    """complexity_indicators and function_list from SQL, over the pages' HTML: counts of each page, and its lines that define something."""
    table(spark, d, "pages").createOrReplaceTempView("searched_pages")
    return sqltools.registered(spark).sql("""SELECT page_id, c.*, (SELECT count(*) FROM function_list(html)) AS n_defined
        FROM (SELECT page_id, regexp_replace(html, '[;>]', '\n') AS html FROM searched_pages WHERE html IS NOT NULL), LATERAL complexity_indicators(html) c""")


#: Ways in which a text is written as bytes before its encoding is told.
FORMS = ("utf-8", "utf-8 marked", "utf-16le marked", "utf-16be", "iso-8859-1")


def encodings_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document written in five ways, its encoding told from the bytes alone and its text read back."""
    docs = table(spark, d, "documents").where("text is not null")
    latin = F.when(docs["text"].rlike(r"^[\x00-\x7F\xA0-\xFF]*$"), F.encode("text", "ISO-8859-1"))
    forms = [
        F.encode("text", "UTF-8"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")),
        F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")), F.encode("text", "UTF-16BE"), latin,
    ]
    named = F.array(*[F.struct(F.lit(n).alias("form"), b.alias("content")) for n, b in zip(FORMS, forms, strict=True)])
    rows = docs.select("doc_id", F.inline(named)).where("content is not null")
    return rows.select("doc_id", "form", encodings.decoded(F.col("content")).alias("d")).select("doc_id", "form", "d.encoding", F.md5("d.text").alias("text_md5"))


QUERIES = {
    "bounded_events": (bounded_events, _bounded_sql()),
    "activity_sources": (activity_sources, f"WITH {_FEED} SELECT * FROM f ORDER BY ts DESC, kind, id LIMIT 200"),
    "activity_of_kind": (activity_of_kind, f"WITH {_FEED} SELECT * FROM f WHERE kind = 'analytics' ORDER BY ts DESC, kind, id LIMIT 50"),
    "pattern_hits": (pattern_hits, rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM l WHERE regexp_matches(body, '(?i){SOUGHT}'))
        SELECT doc_id, CAST(line AS INTEGER) AS line, md5(regexp_replace(body, '\s+$', '')) AS shown_md5 FROM h WHERE nth <= {sqltools.HITS}"""),
    "tool_counts": (tool_counts, """WITH r AS (SELECT page_id, string_split(regexp_replace(html, '[;>]', chr(10), 'g'), chr(10)) AS ls FROM pages WHERE html IS NOT NULL)
        SELECT page_id, CAST(len(ls) AS INTEGER) AS total_lines, CAST(len(list_filter(ls, lambda x: length(x) > 120 AND NOT regexp_matches(x, '^\\s*$'))) AS INTEGER) AS long_lines, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\\b(TODO|FIXME|HACK)\\b'))) AS INTEGER) AS todo_comments,
        CAST(len(list_filter(ls, lambda x: regexp_matches(trim(x), '(^|[^=\\w])\\b[0-9]{2,}\\b(\\s*$|\\s*[^=\\w\\s])'))) AS INTEGER) AS magic_numbers, CAST(len(list_filter(ls, lambda x: DEFS)) AS BIGINT) AS n_defined FROM r""".replace("\\\\", "\\").replace("DEFS", " OR ".join(f"regexp_matches(x, '{p}')" for p in sqltools.DEFINITIONS))),
    "encodings_found": (encodings_found, f"""WITH f AS (SELECT doc_id, text, unnest({list(FORMS)}) AS form FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, form, CASE WHEN form LIKE 'utf-8%' OR text = '' AND form <> 'utf-16le marked' THEN 'utf-8' WHEN form LIKE 'utf-16%' THEN split_part(form, ' ', 1)
            WHEN regexp_matches(text, '^[\\x00-\\x7F]*$') THEN 'utf-8' ELSE 'iso-8859-1' END AS encoding, md5(text) AS text_md5 FROM f WHERE form <> 'iso-8859-1' OR regexp_matches(text, '^[\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}]*$')"""),
}
