"""Queries over feeds, filters, projections, joins, sorts and digests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.functions import dates as D
from corpusflow.functions import text as T
from corpusflow.functions import url as U
from corpusflow.operators import blocklist as B
from corpusflow.operators import feed as O
from corpusflow.operators import search as SE
from corpusflow.operators.feed import FeedQuery
from corpusflow.plans import fixtures as X
from corpusflow.plans.fixtures import AS_OF_SQL, as_of
from corpusflow.runtime import global_rank, shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = X.with_tables(sql)
        return f

    return put


A = lambda s, d: X.articles(s, d)
S = lambda s, d: X.sources(s, d)
PUB = "coalesce(a.published_at, a.created_at)"
FRESH = f"{PUB} <= {AS_OF_SQL} + INTERVAL 2 HOUR"
REDDIT = "(s.name ILIKE '%reddit%' OR a.url ILIKE '%reddit.com%' OR a.title ILIKE '[r/%')"
VOZ = "(s.name ILIKE '%voz%' OR a.url ILIKE '%voz.vn%')"
OTHER = f"NOT ({REDDIT} OR {VOZ})"
TABS = {
    "all": OTHER, "news": f"{OTHER} AND coalesce(s.feed_category, 'news') = 'news'", "tech": f"{OTHER} AND coalesce(s.feed_category, 'news') = 'tech'",
    "voz": VOZ, "reddit": REDDIT, "saved": "a.is_saved",
}
JOIN = "FROM articles a LEFT JOIN sources s ON s.id = a.source_id"
LOCAL = "CAST({} + INTERVAL 7 HOUR AS DATE)"
ORDER = {"latest": f"{PUB} DESC, a.id DESC", "hot": f"coalesce(a.hot_score, 0) DESC, {PUB} DESC, a.id DESC"}


def feed_sql(q: FeedQuery) -> str:
    where = ["true"]
    if not (q.include_future or q.tab == "saved"):
        where.append(FRESH)
    if q.source_id:
        where.append(f"a.source_id = '{q.source_id}'")
    if q.status:
        where.append(f"a.summary_status = '{q.status}'")
    if q.date:
        where.append(f"{LOCAL.format(PUB)} = DATE '{q.date}'")
    if q.tag:
        where.append(f"list_contains(a.tags, '{q.tag}')")
    if q.min_score:
        where.append(f"a.hot_score >= {q.min_score}")
    if q.tab:
        where.append(TABS[q.tab])
    if q.issue:
        where.append("a.summary_status = 'done' AND " + ISSUE[q.issue])
    if not (q.include_followers or q.status or q.issue):
        where.append("a.parent_article_id IS NULL")
    return f"""SELECT a.id, a.title, a.url, a.source_id, s.name AS source_name, a.summary_status, coalesce(a.hot_score, 0) AS hot_score,
    strftime({PUB}, '%Y-%m-%d %H:%M:%S') AS feed_time, (SELECT count(*) FROM articles f WHERE f.parent_article_id = a.id) AS follower_count
    {JOIN} WHERE {' AND '.join(where)} ORDER BY {ORDER[q.sort]} LIMIT {q.limit} OFFSET {(q.page - 1) * q.limit}"""


ISSUE = {
    "missing_tldr": "(a.tldr IS NULL OR trim(a.tldr) = '')", "missing_summary_short": "(a.summary_short IS NULL OR trim(a.summary_short) = '')",
    "missing_tags": "(a.tags IS NULL OR len(a.tags) = 0)", "missing_hot_score": "a.hot_score IS NULL", "short_summary": "length(trim(coalesce(a.summary_text, ''))) < 200",
}
FEEDS = {
    "feed_hot": FeedQuery(tab="all", sort="hot"),
    "feed_latest": FeedQuery(tab="all"),
    "flt01_freshness": FeedQuery(limit=100),
    "flt02_local_day": FeedQuery(date="2024-01-15", limit=100),
    "flt03_source_status_score": FeedQuery(source_id="src5", status="done", min_score=1),
    "flt04_tag": FeedQuery(tag="policy"),
    **{f"flt05_tab_{t}": FeedQuery(tab=t) for t in O.TABS},
    **{f"flt06_{i}": FeedQuery(issue=i) for i in O.ISSUES},
    "flt07_leaders": FeedQuery(include_future=True),
    "flt07_followers_too": FeedQuery(include_followers=True),
    "srt01_hot": FeedQuery(sort="hot"),
    "srt02_page3": FeedQuery(tab="all", page=3, limit=15),
}
for _name, _q in FEEDS.items():
    query(_name, feed_sql(_q))(lambda s, d, q=_q: O.feed(A(s, d), S(s, d), q, as_of()))

_all = FeedQuery(tab="all", limit=20)
query("agg01_page_count", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages {JOIN} WHERE {FRESH} AND {TABS['all']} AND a.parent_article_id IS NULL")(
    lambda s, d: O.page_count(A(s, d), S(s, d), _all, as_of())
)
query("flt06_all_issues", "SELECT a.id, list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in ISSUE.items()) + "], lambda x: x IS NOT NULL) AS issues FROM articles a WHERE a.summary_status = 'done' AND (" + " OR ".join(ISSUE.values()) + ")")(
    lambda s, d: A(s, d).select("id", O.issues().alias("issues")).where("size(issues) > 0")
)
for _name, _tab in (("flt08_search", None), ("srt04_search_tab", "news")):
    _like = "ILIKE '%there%'"
    _hits = f"(coalesce(a.title {_like}, false) OR coalesce(a.summary_short {_like}, false) OR coalesce(a.tldr {_like}, false))"
    query(_name, f"""SELECT a.id, a.title, s.name AS source_name, CASE WHEN coalesce(a.title {_like}, false) THEN 2 ELSE 0 END + CASE WHEN coalesce(a.summary_short {_like}, false) OR coalesce(a.tldr {_like}, false) THEN 1 ELSE 0 END AS relevance,
    strftime({PUB}, '%Y-%m-%d %H:%M:%S') AS feed_time {JOIN} WHERE a.summary_status = 'done' AND {FRESH} AND {_hits} {'AND ' + TABS[_tab] if _tab else ''} ORDER BY relevance DESC, {PUB} DESC, a.id DESC LIMIT 20""")(
        lambda s, d, t=_tab: O.search(A(s, d), S(s, d), "there", as_of(), t)
    )


def _index(s, rows, columns, key="id"):
    """An index of the rows in the shared folder."""
    path = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    SE.add_to_index(rows, path, columns, key=key)
    return path


SQL["flt08_index_search"] = SQL["flt08_search"]
QUERIES["flt08_index_search"] = lambda s, d: O.search(A(s, d), S(s, d), "there", as_of(), index=_index(s, A(s, d), ["title", "summary_short", "tldr"]))
for _name, _pattern in (("flt08_index_pattern", "%th_re%ing %"), ("flt08_index_phrase", "%Of the%")):
    query(_name, f"SELECT doc_id FROM documents WHERE text ILIKE '{_pattern}'")(
        lambda s, d, p=_pattern: X.read(s, d, "documents").transform(lambda r: SE.like(r, _index(s, r, ["text"], "doc_id"), p, ["text"], "doc_id")).select("doc_id")
    )
query("prj02_relevance", "SELECT id, CASE WHEN title ILIKE '%on%' THEN 2 ELSE 0 END + CASE WHEN coalesce(summary_short, '') ILIKE '%on%' THEN 1 ELSE 0 END AS relevance FROM articles")(
    lambda s, d: A(s, d).select("id", (F.when(F.col("title").ilike("%on%"), 2).otherwise(0) + F.when(F.coalesce("summary_short", F.lit("")).ilike("%on%"), 1).otherwise(0)).alias("relevance"))
)
query("prj01_list_projection", f"SELECT a.id, a.title, s.name AS source_name, s.type, a.hot_score, a.tags, strftime(a.created_at, '%Y-%m-%d') AS day {JOIN}")(
    lambda s, d: O.with_sources(A(s, d), S(s, d)).join(S(s, d).select(F.col("id").alias("source_id"), "type"), "source_id", "left").select(
        "id", "title", "source_name", "type", "hot_score", "tags", F.date_format("created_at", "yyyy-MM-dd").alias("day")
    )
)
query("src01_article_scan", "SELECT id, url, title, language, summary_status FROM articles")(lambda s, d: A(s, d).select("id", "url", "title", "language", "summary_status"))
query("src01_source_scan", "SELECT id, type, name, url, is_enabled, fetch_interval_minutes, feed_category FROM sources")(
    lambda s, d: S(s, d).select("id", "type", "name", "url", "is_enabled", "fetch_interval_minutes", "feed_category")
)
query("flt09_date_range", f"SELECT id FROM articles a WHERE {LOCAL.format('a.created_at')} BETWEEN DATE '2024-01-09' AND DATE '2024-01-15'")(
    lambda s, d: A(s, d).where(D.local_date(F.col("created_at")).between(*[F.lit(x).cast("date") for x in D.date_range(None, "2024-01-15", "2024-01-30", 92)])).select("id")
)

# Titles get promotional endings here, so that the filter has something to find.
_promo = "title || CASE WHEN id % 25 = 0 THEN ' - 20% off' WHEN id % 40 = 1 THEN ' promo codes' WHEN id % 30 = 2 THEN ' GIẢM  GIÁ SỐC' WHEN id % 30 = 3 THEN ' KHUYẾN MÃI lớn' WHEN id % 30 = 4 THEN ' Ưu Đãi' ELSE '' END"
_bounded = [p.replace(r"\b", r"(?:\b)").replace("'", "''") for p in C.PROMO_PHRASES]


def _promo_title():
    return F.concat("title", F.when(F.col("id") % 25 == 0, " - 20% off").when(F.col("id") % 40 == 1, " promo codes").when(F.col("id") % 30 == 2, " GIẢM  GIÁ SỐC").when(F.col("id") % 30 == 3, " KHUYẾN MÃI lớn").when(F.col("id") % 30 == 4, " Ưu Đãi").otherwise(""))


query("flt10_promo", f"SELECT id, coalesce({', '.join(f'''nullif(regexp_extract(t, '(?i){p}', 0), '')''' for p in _bounded)}) AS phrase FROM (SELECT id, {_promo} AS t FROM articles) WHERE phrase IS NOT NULL")(
    lambda s, d: A(s, d).select("id", C.promo_phrase(_promo_title()).alias("phrase")).where("phrase is not null")
)
_hints = [p.replace("'", "''") for p in C.PROMO_HINTS]
query("flt10_promo_hints", f"SELECT id FROM (SELECT id, {_promo} || ' ' || substr(raw_excerpt, 1, 400) AS t FROM articles) WHERE {' OR '.join(f'''regexp_matches(t, '(?i){p}')''' for p in _hints)}")(
    lambda s, d: A(s, d).where(C.has_promo_hint(_promo_title(), F.col("raw_excerpt"))).select("id")
)
_pages = lambda s, d: X.read(s, d, "pages")
H = "regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '')"
P = "regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
query("flt11_junk_url", f"SELECT page_id, regexp_matches({P}, '/(videos?|audio|podcasts?)/') OR {H} = 'bloomberg.com' AS junk FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", U.is_junk(F.col("url")).alias("junk"))
)
_ips = "['http://10.1.2.3/a', 'http://8.8.8.8/b', 'http://192.168.0.9/', 'http://172.20.1.1/x', 'http://100.64.0.1/', 'http://localhost/x', 'ftp://a.example.com/', 'http://0x7f.1/']"
query("flt12_public_url", f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE {_ips}[page_id % 8 + 1] END AS url FROM pages)
SELECT page_id, url, regexp_matches(lower(url), '^https?://') AND (url LIKE '%example%' OR url LIKE '%8.8.8.8%') AS is_public FROM u""")(
    lambda s, d: _pages(s, d).select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.element_at(F.array(*[F.lit(x.strip(" '[]")) for x in _ips.split(",")]), (F.col("page_id") % 8 + 1).cast("int"))).alias("url"))
    .select("page_id", "url", U.public_url(F.col("url")).isNotNull().alias("is_public"))
)
query("flt13_blocked_page", "SELECT page_id, length(html) <= 50000 AND (" + " OR ".join("contains(lower(html), '" + m.replace("'", "''") + "')" for m in C.BLOCK_MARKERS) + ") AS blocked, length(html) < 500 OR " + " OR ".join(f"contains(lower(substr(html, 1, 4000)), '{m}')" for m in C.EMPTY_PAGE_MARKERS) + " AS blocked_or_empty FROM pages")(
    lambda s, d: _pages(s, d).select("page_id", C.is_blocked_page(F.col("html")).alias("blocked"), C.is_blocked_or_empty(F.col("html")).alias("blocked_or_empty"))
)
SQZ = r"trim(regexp_replace(coalesce({}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"
query("flt14_length_gate", f"""SELECT id, content_type = 'video' OR greatest(length({SQZ.format('raw_content')}), length({SQZ.format('raw_excerpt')})) >=
    CASE WHEN regexp_matches(coalesce(language, ''), '(?i)^(zh|ja|ko)(-|$)') THEN 160 ELSE 450 END AS long_enough FROM articles""")(
    lambda s, d: A(s, d).select("id", C.long_enough(F.col("language"), F.col("raw_content"), F.col("raw_excerpt"), F.col("content_type")).alias("long_enough"))
)
query("flt15_usable_extraction", f"""WITH t AS (SELECT id, {SQZ.format('raw_content')} AS t FROM articles)
SELECT id, length(t) >= 500 AND len(string_split(t, ' ')) >= 80 AND (len(list_filter(regexp_split_to_array(t, '[.!?。！？]\\s+'), lambda p: length(trim(p)) > 30)) >= 2 OR length(t) >= 1000) AS usable FROM t""")(
    lambda s, d: A(s, d).select("id", C.is_usable_extraction(F.col("raw_content")).alias("usable"))
)
query("flt18_forum_article", "SELECT a.id, regexp_matches(a.url || ' ' || coalesce(s.name, ''), '(?i)voz|reddit') OR starts_with(coalesce(a.title, ''), '[r/') AS is_forum FROM articles a LEFT JOIN sources s ON s.id = a.source_id")(
    lambda s, d: O.with_sources(A(s, d), S(s, d)).select("id", C.is_forum_article(F.col("url"), F.col("source_name"), F.col("title")).alias("is_forum"))
)
_ref = C.REFUSAL_START.replace("'", "''")
_top = C.REFUSAL_TOPIC.replace("'", "''")
_out = "CASE WHEN id % 9 = 0 THEN 'I cannot help with that request. ' || substr(raw_excerpt, 1, 50) WHEN id % 9 = 1 THEN 'Sorry, ' || substr(raw_excerpt, 1, 40) ELSE substr(raw_excerpt, 1, 80) END"
query("flt20_refusals", rf"""WITH t AS (SELECT id, trim(regexp_replace({_out}, '[\s\x{{00A0}}]+', ' ', 'g')) AS t, coalesce(last_summary_error, '') AS e FROM articles)
SELECT id, t <> '' AND length(t) <= 1200 AND regexp_matches(t, '(?i){_ref}') AND regexp_matches(t, '(?i){_top}') AS refusal, regexp_matches(e, '(?i)safety|high-risk|rejected') AS rejected FROM t""")(
    lambda s, d: A(s, d).select("id", C.is_refusal(F.expr(_out)).alias("refusal"), C.is_safety_rejection(F.col("last_summary_error")).alias("rejected"))
)
query("flt21_personal_feed", "SELECT id FROM articles a WHERE NOT list_has_any(list_transform(coalesce(tags, []), lambda t: lower(trim(t))), ['policy', 'sports']) AND id IN (SELECT id FROM articles WHERE is_saved)")(
    lambda s, d: O.personal(A(s, d), ["Policy", " sports"], A(s, d).where("is_saved")).select("id")
)
query("flt22_fresh_badge", f"SELECT a.id, date_diff('second', {PUB}, {AS_OF_SQL}) BETWEEN 0 AND 21600 AS is_new FROM articles a")(lambda s, d: A(s, d).select("id", O.is_new(as_of()).alias("is_new")))
query("flt23_json_key", "SELECT id FROM logs WHERE json_extract(metadata, '$.forum') IS NOT NULL")(lambda s, d: X.logs(s, d).where(F.get_json_object("metadata", "$.forum").isNotNull()).select("id"))

# Joins
query("jn01_left_sources", f"SELECT a.id, s.name AS source_name, s.feed_category {JOIN}")(lambda s, d: O.with_sources(A(s, d), S(s, d)).select("id", "source_name", "feed_category"))


def _items(s, d):
    i = F.col("id")
    return A(s, d).where("is_saved").select((i % 3).alias("digest_id"), i.alias("article_id"), F.when(i % 2 == 0, "top").otherwise("more").alias("section"))


_items_sql = "items AS (SELECT id % 3 AS digest_id, id AS article_id, CASE WHEN id % 2 = 0 THEN 'top' ELSE 'more' END AS section FROM articles WHERE is_saved)"
query("jn02_digest_items", f"WITH {_items_sql} SELECT i.digest_id, i.article_id, i.section, a.title, s.name AS source_name FROM items i JOIN articles a ON a.id = i.article_id LEFT JOIN sources s ON s.id = a.source_id")(
    lambda s, d: O.with_sources(A(s, d), S(s, d)).withColumnRenamed("id", "article_id").join(_items(s, d), "article_id").select("digest_id", "article_id", "section", "title", "source_name")
)
query("jn06_follower_counts", "SELECT a.id, (SELECT count(*) FROM articles f WHERE f.parent_article_id = a.id) AS n FROM articles a WHERE a.parent_article_id IS NULL")(
    lambda s, d: A(s, d).where("parent_article_id is null").select("id").join(O.follower_counts(A(s, d)), "id", "left").select("id", F.coalesce("follower_count", F.lit(0)).alias("n"))
)
query("jn07_siblings", "SELECT a.id, b.id AS sibling FROM articles a JOIN articles b ON coalesce(a.parent_article_id, a.id) = coalesce(b.parent_article_id, b.id) AND a.id <> b.id WHERE a.id IN (SELECT doc_id FROM labels WHERE quality = 1)")(
    lambda s, d: O.siblings(A(s, d), X.read(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")))
)
query("clu08_cluster_view", "SELECT id, coalesce(parent_article_id, id) AS leader_id, count(*) OVER (PARTITION BY coalesce(parent_article_id, id)) AS members FROM articles")(
    lambda s, d: O.cluster_view(A(s, d))
)
_block = f"""WITH u AS (SELECT DISTINCT url, {H} AS h, regexp_replace(lower(url), '^https?://(www\\.)?', '') AS bare FROM pages WHERE url IS NOT NULL),
hit AS (SELECT url, CASE type WHEN 'domain' THEN 0 ELSE 1 END AS kind, pattern, id FROM u, blocklist WHERE CASE WHEN type = 'domain' THEN h = pattern OR ends_with(h, '.' || pattern)
    WHEN contains(pattern, '*') THEN regexp_matches(bare, '^' || replace(replace(pattern, '.', '\\.'), '*', '[^?#]*')) ELSE starts_with(bare, pattern) OR contains(bare, '/' || pattern) END)"""
query("jn08_blocklist", _block + " SELECT url, arg_min(id, (kind, pattern))::BIGINT AS id, arg_min(pattern, (kind, pattern)) AS pattern FROM hit GROUP BY url")(lambda s, d: B.match(_pages(s, d), X.blocklist(s, d)))
query("agg29_blocklist_hits", _block + ", one AS (SELECT url, arg_min(id, (kind, pattern))::BIGINT AS id FROM hit GROUP BY url) SELECT b.id::BIGINT AS id, b.pattern, count(p.page_id) AS hits FROM blocklist b LEFT JOIN one ON one.id = b.id LEFT JOIN pages p ON p.url = one.url GROUP BY ALL")(
    lambda s, d: X.blocklist(s, d).join(B.hits(_pages(s, d), X.blocklist(s, d)), "id", "left").select("id", "pattern", F.coalesce("hits", F.lit(0)).alias("hits"))
)
query("jn12_profile_lookup", f"SELECT p.page_id, t.min_text_length FROM (SELECT page_id, {H} AS h FROM pages) p LEFT JOIN (VALUES ('cheap-pills.example.com', 300), ('spam-farm.example.org', 800)) t(domain, min_text_length) ON t.domain = p.h")(
    lambda s, d: _pages(s, d).select("page_id", U.host(F.col("url")).alias("domain")).join(s.createDataFrame([("cheap-pills.example.com", "article", 300), ("spam-farm.example.org", "article", 800)], "domain string, mode string, min_text_length int").where("mode = 'article'"), "domain", "left").select("page_id", "min_text_length")
)
query("jn13_unnest_tags", "SELECT id, unnest(tags) AS tag FROM articles")(lambda s, d: A(s, d).select("id", F.explode("tags").alias("tag")))
query("jn14_batch_ids", "SELECT id, title FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")(
    lambda s, d: A(s, d).join(X.read(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "title")
)

# Tags, days, digests
query("agg02_tag_counts", f"SELECT tag, count(*) AS n FROM (SELECT unnest(a.tags) AS tag {JOIN} WHERE a.summary_status = 'done' AND {FRESH} AND {TABS['all']}) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")(
    lambda s, d: O.tag_counts(A(s, d), S(s, d), as_of())
)
_days = f"SELECT strftime({LOCAL.format(PUB)}, '%Y-%m-%d') AS date, count(*) AS n FROM articles a WHERE {FRESH} AND a.parent_article_id IS NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 60"
query("agg03_day_counts", _days)(lambda s, d: O.day_counts(A(s, d), as_of()))
query("win03_day_steps", f"SELECT date, lead(date) OVER (ORDER BY date DESC) AS older, lag(date) OVER (ORDER BY date DESC) AS newer FROM ({_days})")(lambda s, d: O.day_steps(A(s, d), as_of()))
_cand = f"""SELECT row_number() OVER (ORDER BY a.hot_score DESC NULLS LAST, a.published_at DESC NULLS LAST, a.id)::INT AS position, a.id AS article_id, s.name AS source_name, a.title {JOIN}
    WHERE a.summary_status = 'done' AND {PUB} > {AS_OF_SQL} - INTERVAL 24 HOUR AND {PUB} <= {AS_OF_SQL} ORDER BY position LIMIT 500"""
_c = lambda s, d: O.digest_candidates(A(s, d), S(s, d), as_of())
query("st15_digest_items", f"SELECT position, article_id, source_name, title, position || '. [' || coalesce(source_name, '?') || '] ' || title AS line FROM ({_cand})")(_c)
query("st15_digest_text", f"SELECT count(*) AS article_count, coalesce(string_agg(position || '. [' || coalesce(source_name, '?') || '] ' || title, chr(10) ORDER BY position), '') AS body FROM ({_cand})")(lambda s, d: O.digest(_c(s, d)))
query("st16_digest_short", f"SELECT 'Today' || chr(10) || coalesce(string_agg('- ' || title, chr(10) ORDER BY position), '') AS body FROM ({_cand}) WHERE position <= 5")(lambda s, d: O.short_digest(_c(s, d), "Today"))
query("agg25_digest_by_source", f"SELECT coalesce(source_name, '?') AS label, count(*) AS n FROM ({_cand}) GROUP BY 1")(lambda s, d: O.digest_by_source(_c(s, d)))


def _digests(s, d):
    day = D.local_date_text(F.col("created_at"))
    return A(s, d).groupBy(day.alias("digest_date")).agg(F.count(F.lit(1)).alias("article_count"), F.max("title").alias("title"))


_digests_sql = f"SELECT strftime({LOCAL.format('created_at')}, '%Y-%m-%d') AS digest_date, count(*) AS article_count, max(title) AS title FROM articles GROUP BY 1"
query("st17_digest_latest", f"SELECT * FROM ({_digests_sql}) ORDER BY digest_date DESC LIMIT 1")(lambda s, d: _digests(s, d).orderBy(F.col("digest_date").desc()).limit(1))
query("st17_index_search", f"SELECT *, 2 AS relevance FROM ({_digests_sql}) WHERE title ILIKE '%the%' ORDER BY digest_date DESC LIMIT 30")(
    lambda s, d: SE.like(_digests(s, d), _index(s, _digests(s, d), ["title"], "digest_date"), "%the%", ["title"], "digest_date").withColumn("relevance", F.lit(2)).orderBy(F.col("digest_date").desc()).limit(30)
)
query("st17_digest_search", f"SELECT *, 2 AS relevance FROM ({_digests_sql}) WHERE title ILIKE '%th%' ORDER BY digest_date DESC LIMIT 30")(
    lambda s, d: _digests(s, d).where(F.col("title").ilike("%th%")).withColumn("relevance", F.lit(2)).orderBy(F.col("digest_date").desc()).limit(30)
)

# Sorts and sets
query("srt03_status_rank", "SELECT id, status FROM jobs ORDER BY CASE status WHEN 'fetching' THEN 0 WHEN 'discovered' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, updated_at DESC, id LIMIT 50")(
    lambda s, d: X.jobs(s, d).orderBy(F.when(F.col("status") == "fetching", 0).when(F.col("status") == "discovered", 1).when(F.col("status") == "failed", 2).otherwise(3), F.col("updated_at").desc(), "id").limit(50).select("id", "status")
)
query("srt05_due_order", f"SELECT id, row_number() OVER (ORDER BY coalesce(next_run_at, created_at), name) AS place FROM sources WHERE is_enabled AND (next_run_at IS NULL OR next_run_at <= {AS_OF_SQL})")(
    lambda s, d: S(s, d).where(F.col("is_enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of()))).transform(lambda r: global_rank(r, [F.coalesce("next_run_at", "created_at"), F.col("name")], "place")).select("id", "place")
)
query("srt06_newest_batch", "SELECT id FROM jobs WHERE status = 'discovered' ORDER BY created_at DESC, id DESC LIMIT 30")(
    lambda s, d: X.jobs(s, d).where("status = 'discovered'").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(30).select("id")
)
query("srt07_source_order", "SELECT id, name, row_number() OVER (ORDER BY is_enabled DESC, created_at DESC, id) AS place FROM sources")(
    lambda s, d: global_rank(S(s, d), [F.col("is_enabled").desc(), F.col("created_at").desc(), F.col("id")], "place").select("id", "name", "place")
)
DOM = "regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '[/?#].*$', '')"
query("set01_union", "SELECT url FROM articles UNION ALL SELECT url FROM pages WHERE url IS NOT NULL")(lambda s, d: A(s, d).select("url").unionByName(_pages(s, d).select("url").where("url is not null")))
query("set02_distinct_domains", f"SELECT DISTINCT {DOM} AS domain FROM pages WHERE url IS NOT NULL")(lambda s, d: _pages(s, d).where("url is not null").select(U.domain(F.col("url")).alias("domain")).distinct())
query("set03_domain_difference", f"SELECT DISTINCT {DOM} AS domain FROM pages WHERE page_id % 2 = 0 AND url IS NOT NULL EXCEPT SELECT {DOM} FROM pages WHERE page_id % 2 = 1 AND url IS NOT NULL")(
    lambda s, d: _pages(s, d).where("page_id % 2 = 0 and url is not null").select(U.domain(F.col("url")).alias("domain")).distinct().join(_pages(s, d).where("page_id % 2 = 1 and url is not null").select(U.domain(F.col("url")).alias("domain")).distinct(), "domain", "left_anti")
)
WORDS = "list_distinct(list_filter(string_split({}, ' '), lambda t: length(t) >= 2))"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '<[^>]+>', ' ', 'g'), '[\p{{P}}\p{{S}}]', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))"
query("set04_token_sets", f"""WITH t AS (SELECT id, {WORDS.format(NORM.format('title'))} AS a, {WORDS.format(NORM.format('raw_excerpt'))} AS b FROM articles)
SELECT id, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS united, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM t""")(
    lambda s, d: A(s, d).select("id", T.word_set(T.similarity_text(F.col("title"))).alias("a"), T.word_set(T.similarity_text(F.col("raw_excerpt"))).alias("b")).select(
        "id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_union("a", "b")).cast("long").alias("united"), F.size(F.array_except("a", "b")).cast("long").alias("only_a")
    )
)
