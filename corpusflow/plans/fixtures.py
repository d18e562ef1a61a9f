"""The logical tables, derived from the given ones; each rule is stated for Spark and for DuckDB.

``SQL`` holds the DuckDB form of every table; ``with_tables`` puts the needed
ones in front of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.runtime import read

START = 1704067200  # 2024-01-01 00:00:00 UTC
AS_OF_TEXT = "2024-01-30 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"
ALLOWED_TAGS = ["AI", "Economy", "Policy", "Science", "Sports"]


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    created = F.lit(START) + (i * 43 % 43200) * 60
    text, source = F.col("text"), F.col("source")
    none = F.lit(None)
    tags = (
        F.when(i % 7 == 0, F.array().cast("array<string>")).when(i % 7 == 1, F.array(F.lit("ai"))).when(i % 7 == 2, F.array(F.lit("economy"), F.lit("ai")))
        .when(i % 7 == 3, F.array(F.lit("policy"))).when(i % 7 == 4, F.array(F.lit("policy"), F.lit("science"))).when(i % 7 == 6, F.array(F.lit("sports")))
    )
    status = (
        F.when(i % 50 == 27, "processing").when(i % 10 <= 6, "done").when(i % 10 == 7, "pending").when(i % 10 == 8, "failed").otherwise("skipped")
    )
    error = (
        F.when(i % 10 == 9, "Source content too short").when((i % 10 == 8) & (i % 3 == 0), "timeout after 30s").when((i % 10 == 8) & (i % 3 == 1), "HTTP 404 gone")
    )
    return d.select(
        i.alias("id"), source.alias("source_id"), F.concat(F.lit("https://"), source, F.lit(".example.com/a/"), i.cast("string")).alias("url"),
        F.substring(F.substring_index(text, ".", 1), 1, 120).alias("title"), F.when(i % 17 != 0, _at(created - (i % 90) * 60)).alias("published_at"),
        F.when(i % 23 == 0, "video").otherwise("article").alias("content_type"), F.col("lang").alias("language"), F.substring(text, 1, 500).alias("raw_excerpt"),
        text.alias("raw_content"), F.substring(text, 1, (100 + i % 400).cast("int")).alias("summary_text"), status.alias("summary_status"),
        F.when(i % 3 != 0, F.concat(F.lit("https://img.example.com/"), (i % 200).cast("string"))).alias("image_url"), _at(created).alias("created_at"),
        _at(created + (i % 300) * 60).alias("updated_at"), F.when(i % 11 == 0, none).when(i % 11 == 1, "").otherwise(F.substring(text, 1, 150)).alias("tldr"),
        (i % 4).cast("int").alias("rescraped_count"), F.when(i % 13 != 0, (1 + i % 10)).cast("int").alias("hot_score"), tags.alias("tags"),
        F.when(i % 19 != 0, F.substring(text, 1, 90)).alias("summary_short"), (i % 5).cast("int").alias("retry_count"), error.alias("last_summary_error"),
        F.when(i % 6 == 5, i - 5).alias("parent_article_id"), (i % 29 == 0).alias("is_saved"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("id")).distinct()
    n = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    d = d.withColumn("n", n)
    n = F.col("n")
    ts = as_of()
    return d.select(
        "id", F.when(n % 3 == 0, "rss").when(n % 3 == 1, "web").otherwise("youtube").alias("type"),
        F.when(n == 1, "Reddit data").when(n == 2, "VOZ forum").otherwise(F.upper("id")).alias("name"),
        F.concat(F.lit("https://"), F.col("id"), F.lit(".example.com/")).alias("url"), (n % 7 != 6).alias("is_enabled"),
        F.when(n % 4 == 3, n * 10).otherwise(60).cast("int").alias("fetch_interval_minutes"), F.when(n % 4 > 1, n % 4).otherwise(0).cast("int").alias("consecutive_failures"),
        F.when(n % 9 != 8, _at(F.unix_timestamp(ts) - n * 7 * 3600)).alias("last_success_at"),
        F.when(n % 6 != 5, _at(F.unix_timestamp(ts) + (n - 10) * 1800)).alias("next_run_at"), _at(F.lit(START) + n * 60).alias("created_at"),
        F.when(n % 5 != 4, F.when(n % 2 == 0, "news").otherwise("tech")).alias("feed_category"),
    )


ERRORS = (
    "Request timed out after 20s", "HTTP 404 Not found", "HTTP 503 bad gateway", "Cloudflare challenge page", "HTTP 429 too many requests", "HTTP 403 forbidden",
    "Paywall detected", "Article content too short", "socket hang up", "URL must be a public http(s) address",
)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    created = F.unix_timestamp(as_of()) - (k * 7 % 9000) * 60
    status = F.when(k % 5 == 0, "discovered").when(k % 5 == 1, "done").when(k % 5 == 2, "failed").when(k % 5 == 3, "skipped").otherwise("fetching")
    error = F.when(k % 5 == 2, F.when(k % 23 == 2, F.lit(None)).otherwise(F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (k % 10 + 1).cast("int"))))
    payload = F.when(k % 11 == 0, F.concat(F.lit('{"rescueArticleId": "'), (k % 1000).cast("string"), F.lit('"}'))).when(k % 13 == 0, '{"isManualSave": true}')
    return o.select(
        k.alias("id"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("source_id"),
        F.concat(F.lit("https://www.site"), (k % 40).cast("string"), F.lit(".example.com/p/"), k.cast("string")).alias("url"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"), payload.alias("payload_json"), status.alias("status"), (k % 6).cast("int").alias("retry_count"),
        error.alias("last_error"), _at(created).alias("created_at"), _at(created + (k % 37) * 60).alias("updated_at"),
        F.when(k % 5 == 3, "stale").alias("skip_reason"), F.when((k % 5 == 2) & (k % 3 != 0), F.when(k % 4 == 0, "not_found").otherwise("timeout")).alias("error_type"),
        F.when((k % 5 == 2) & (k % 3 == 1), 404 + k % 2).cast("int").alias("last_http_status"),
        F.when((k % 5 == 2) & (k % 2 == 0), _at(created + (k % 37) * 60 + 600)).alias("next_attempt_at"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    found = F.floor("value").cast("int")
    forum = F.concat(
        F.lit('{"forum": {"kind": "'), F.when(F.col("user_id") % 2 == 0, "reddit").otherwise("voz"), F.lit('", "threadsSeen": '), found.cast("string"),
        F.lit(', "inserted": '), (F.col("event_id") % 3).cast("string"), F.lit("}}"),
    )
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("success").alias("status"),
        F.date_trunc("second", "ts").alias("started_at"), found.alias("items_found"), F.when(F.col("event_type") == "purchase", found).otherwise(0).cast("int").alias("items_inserted"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP 50"), (F.col("event_id") % 5).cast("string"))).alias("error_message"),
        F.when(F.col("event_id") % 4 == 0, forum).otherwise(F.col("props")).alias("metadata"),
    )


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_lines_of(read(spark, sf_dir, "events"))


def access_lines_of(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    agent = F.when(i % 5 == 0, "Googlebot/2.1").otherwise("Mozilla/5.0")
    route = F.when(i % 17 == 0, "/wp-login.php").otherwise(F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), (i % 70).cast("string")))
    line = F.format_string(
        '10.0.%d.%d - - [%s +0700] "GET %s HTTP/1.1" %d 512 "-" "%s"', F.col("user_id") % 4, F.col("user_id") % 250,
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), route, F.when(i % 10 == 0, 404).otherwise(200), agent,
    )
    return e.select(F.when(i % 101 == 0, "garbage line").otherwise(line).alias("value"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    t = F.col("turn")
    return c.select(
        F.col("conv_id").alias("thread"), F.col("role").alias("author"), F.col("text").alias("body"), ((F.col("conv_id") * 7 + t * 3) % 60).cast("int").alias("reactions"),
        (1 + F.floor(t / 3)).cast("int").alias("page"), (t % 3).cast("int").alias("order"),
    )


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the hosts that occur in ``pages``; the table decides which of them count."""
    rows = [(1, "cheap-pills.example.com", "domain"), (2, "spam-farm.example.org", "domain"), (3, "en/7", "path"), (4, "ads-track.example.org/*/5", "path")]
    return spark.createDataFrame(rows, "id long, pattern string, type string")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusflow.sources.logs import parse_access_log

    return parse_access_log(access_lines(spark, sf_dir))


SQL = {
    "articles": """SELECT doc_id AS id, source AS source_id, 'https://' || source || '.example.com/a/' || doc_id AS url,
    substr(split_part(text, '.', 1), 1, 120) AS title, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 43 % 43200) AS created_at,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id * 43 % 43200 - doc_id % 90) END AS published_at,
    CASE WHEN doc_id % 23 = 0 THEN 'video' ELSE 'article' END AS content_type, lang AS language, substr(text, 1, 500) AS raw_excerpt, text AS raw_content,
    substr(text, 1, 100 + doc_id % 400) AS summary_text,
    CASE WHEN doc_id % 50 = 27 THEN 'processing' WHEN doc_id % 10 <= 6 THEN 'done' WHEN doc_id % 10 = 7 THEN 'pending' WHEN doc_id % 10 = 8 THEN 'failed' ELSE 'skipped' END AS summary_status,
    CASE WHEN doc_id % 3 <> 0 THEN 'https://img.example.com/' || (doc_id % 200) END AS image_url,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id * 43 % 43200 + doc_id % 300) AS updated_at,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '' ELSE substr(text, 1, 150) END AS tldr, (doc_id % 4)::INT AS rescraped_count,
    CASE WHEN doc_id % 13 <> 0 THEN (1 + doc_id % 10)::INT END AS hot_score,
    CASE doc_id % 7 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['ai'] WHEN 2 THEN ['economy', 'ai'] WHEN 3 THEN ['policy'] WHEN 4 THEN ['policy', 'science'] WHEN 6 THEN ['sports'] END AS tags,
    CASE WHEN doc_id % 19 <> 0 THEN substr(text, 1, 90) END AS summary_short, (doc_id % 5)::INT AS retry_count,
    CASE WHEN doc_id % 10 = 9 THEN 'Source content too short' WHEN doc_id % 10 = 8 AND doc_id % 3 = 0 THEN 'timeout after 30s' WHEN doc_id % 10 = 8 AND doc_id % 3 = 1 THEN 'HTTP 404 gone' END AS last_summary_error,
    CASE WHEN doc_id % 6 = 5 THEN doc_id - 5 END AS parent_article_id, doc_id % 29 = 0 AS is_saved FROM documents""",
    "sources": f"""SELECT id, CASE n % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'web' ELSE 'youtube' END AS type,
    CASE n WHEN 1 THEN 'Reddit data' WHEN 2 THEN 'VOZ forum' ELSE upper(id) END AS name, 'https://' || id || '.example.com/' AS url, n % 7 <> 6 AS is_enabled,
    CASE WHEN n % 4 = 3 THEN n * 10 ELSE 60 END AS fetch_interval_minutes, CASE WHEN n % 4 > 1 THEN n % 4 ELSE 0 END AS consecutive_failures,
    CASE WHEN n % 9 <> 8 THEN {AS_OF_SQL} - to_hours(n * 7) END AS last_success_at, CASE WHEN n % 6 <> 5 THEN {AS_OF_SQL} + to_minutes((n - 10) * 30) END AS next_run_at,
    TIMESTAMP '2024-01-01' + to_minutes(n) AS created_at, CASE WHEN n % 5 <> 4 THEN CASE WHEN n % 2 = 0 THEN 'news' ELSE 'tech' END END AS feed_category
    FROM (SELECT DISTINCT source AS id, coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) AS n FROM documents WHERE source IS NOT NULL)""",
    "jobs": f"""SELECT o_orderkey AS id, 'src' || (o_orderkey % 20) AS source_id, 'https://www.site' || (o_orderkey % 40) || '.example.com/p/' || o_orderkey AS url,
    'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 11 = 0 THEN '{{"rescueArticleId": "' || (o_orderkey % 1000) || '"}}' WHEN o_orderkey % 13 = 0 THEN '{{"isManualSave": true}}' END AS payload_json,
    CASE o_orderkey % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'fetching' END AS status, (o_orderkey % 6)::INT AS retry_count,
    CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 23 <> 2 THEN [{", ".join(f"'{e}'" for e in ERRORS)}][o_orderkey % 10 + 1] END AS last_error,
    {AS_OF_SQL} - to_minutes(o_orderkey * 7 % 9000) AS created_at, {AS_OF_SQL} - to_minutes(o_orderkey * 7 % 9000 - o_orderkey % 37) AS updated_at,
    CASE WHEN o_orderkey % 5 = 3 THEN 'stale' END AS skip_reason,
    CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'not_found' ELSE 'timeout' END END AS error_type,
    CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 3 = 1 THEN (404 + o_orderkey % 2)::INT END AS last_http_status,
    CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 2 = 0 THEN {AS_OF_SQL} - to_minutes(o_orderkey * 7 % 9000 - o_orderkey % 37 - 10) END AS next_attempt_at FROM orders""",
    "logs": """SELECT event_id AS id, 'src' || (user_id % 20) AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status,
    date_trunc('second', ts) AS started_at, floor(value)::INT AS items_found, CASE WHEN event_type = 'purchase' THEN floor(value)::INT ELSE 0 END AS items_inserted,
    CASE WHEN event_type = 'error' THEN 'HTTP 50' || (event_id % 5) END AS error_message,
    CASE WHEN event_id % 4 = 0 THEN '{"forum": {"kind": "' || CASE WHEN user_id % 2 = 0 THEN 'reddit' ELSE 'voz' END || '", "threadsSeen": ' || floor(value)::INT || ', "inserted": ' || (event_id % 3) || '}}' ELSE props END AS metadata FROM events""",
    "visits": """SELECT '10.0.' || (user_id % 4) || '.' || (user_id % 250) AS ip, ts::DATE AS date, 'GET' AS method,
    CASE WHEN event_id % 17 = 0 THEN '/wp-login.php' ELSE '/' || event_type || '/' || (event_id % 70) END AS path, CASE WHEN event_id % 10 = 0 THEN 404 ELSE 200 END AS status,
    event_id % 5 = 0 OR event_id % 17 = 0 AS is_bot, false AS is_internal FROM events WHERE event_id % 101 <> 0""",
    "comments": """SELECT conv_id AS thread, role AS author, text AS body, ((conv_id * 7 + turn * 3) % 60)::INT AS reactions, (1 + turn // 3)::INT AS page, (turn % 3)::INT AS "order" FROM conversations""",
    "blocklist": """SELECT * FROM (VALUES (1, 'cheap-pills.example.com', 'domain'), (2, 'spam-farm.example.org', 'domain'), (3, 'en/7', 'path'), (4, 'ads-track.example.org/*/5', 'path')) t(id, pattern, type)""",
}
for _name in ("articles", "sources"):
    SQL[_name] = SQL[_name].replace("\\\\d", "\\d")


def with_tables(query: str) -> str:
    """The query with the logical tables that it names put in front."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", query)]
    front = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    if not front:
        return query
    body = query.strip()
    if match := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {match[1] or ''}{front}, {body[match.end():]}"
    return f"WITH {front} {body}"
