"""Queries over feeds, sitemaps, pages, JSON documents and captions made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.plans import fixtures as X
from corpusflow.plans.fixtures import AS_OF_SQL, as_of
from corpusflow.plans.q_feed import SQZ
from corpusflow.plans.q_text import NORM_URL, _ent
from corpusflow.runtime import read
from corpusflow.sources import feeds as FE
from corpusflow.sources import html as HT
from corpusflow.sources import jsondocs as JS
from corpusflow.sources import logs as LG

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = X.with_tables(sql)
        return f

    return put


A = X.articles
P = lambda s, d: read(s, d, "pages")
c = F.col


def _xml(col):
    return F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def feed_documents(s, d):
    """RSS documents of up to a few items each: one per source and hundred of ids."""
    i = c("id")
    item = F.concat(
        F.lit("<item><title>T "), i.cast("string"), F.lit("</title><link>"), F.when(i % 10 != 3, c("url")).otherwise(F.lit("")), F.lit("</link>"),
        F.when(i % 2 == 0, F.concat(F.lit("<guid>g"), i.cast("string"), F.lit("</guid>"))).otherwise(F.lit("")),
        F.when(i % 3 == 0, F.concat(F.lit("<dc:date>"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("</dc:date>"))).otherwise(F.concat(F.lit("<pubDate>"), F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("</pubDate>"))),
        F.lit("<description><![CDATA["), _xml(c("raw_excerpt")), F.lit("]]></description></item>"),
    )
    rows = A(s, d).select("source_id", F.floor(i / 100).alias("part"), i.alias("id"), item.alias("item"))
    docs = rows.groupBy("source_id", "part").agg(F.sort_array(F.collect_list(F.struct("id", "item"))).alias("items"))  # at most 100 ids a document
    return docs.select("source_id", "part", F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("xml"))


_snip = SQZ.format(_ent.format("regexp_replace(raw_excerpt, '<[^>]+>', ' ', 'g')"))
_items = f"""SELECT source_id, id // 100 AS part, (row_number() OVER (PARTITION BY source_id, id // 100 ORDER BY id) - 1)::INT AS pos, 'T ' || id AS title, url AS link, CASE WHEN id % 2 = 0 THEN 'g' || id ELSE url END AS guid,
CASE WHEN id % 3 = 0 THEN strftime(created_at, '%Y-%m-%d') ELSE strftime(created_at, '%Y-%m-%d %H:%M') END AS pub_date, {_snip} AS snippet, id FROM articles"""
query("src02_rss_items", f"SELECT * EXCLUDE (id) FROM ({_items}) WHERE id % 10 <> 3")(
    lambda s, d: FE.rss_items(feed_documents(s, d)).select("source_id", "part", "pos", "title", "link", "guid", "pub_date", "snippet")
)
query("src03_feed_diagnostics", f"SELECT page_id, substr({SQZ.format(chr(34) + 'b' + chr(34))}, 1, 240) AS diagnostics FROM (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS b FROM pages)")(
    lambda s, d: P(s, d).select("page_id", FE.feed_diagnostics(c("html")).alias("diagnostics"))
)
query("src04_rss_discovery", f"SELECT source_id, link AS url, title, guid AS external_id FROM (SELECT * FROM ({_items}) WHERE id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos, link) <= 20)")(
    lambda s, d: FE.discover(FE.rss_items(feed_documents(s, d)), "source_id", F.lit("https://feeds.example.com/x")).select("source_id", "url", "title", "external_id")
)
query("src05_recovered_url", "SELECT id, CASE WHEN id % 3 = 0 THEN 'https://real.example.com/story/' || id WHEN id % 3 = 1 THEN 'https://news.ycombinator.com/item?id=' || id ELSE url END AS url FROM articles")(
    lambda s, d: A(s, d).select("id", FE.recovered_url(
        F.when(c("id") % 3 == 2, c("url")).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), c("id").cast("string"))),
        F.when(c("id") % 3 != 1, F.concat(F.lit("<p>Article URL: https://real.example.com/story/"), c("id").cast("string"), F.lit("</p><p>Comments URL: x</p>"))).otherwise("none"), F.lit("https://a.example.com/feed")).alias("url"))
)


def sitemap_documents(s, d):
    i = c("page_id")
    entry = F.concat(
        F.lit("<url><loc>"), _xml(c("url")), F.lit("</loc>"), F.when(i % 2 == 0, F.concat(F.lit("<news:title>N "), i.cast("string"), F.lit("</news:title>"))).otherwise(F.lit("")),
        F.when(i % 3 != 0, F.concat(F.lit("<lastmod>"), F.date_format(F.timestamp_seconds(F.unix_timestamp(as_of()) - (i % 5) * 86400), "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"),
    )
    rows = P(s, d).where("url is not null").select(F.floor(i / 50).alias("part"), i.alias("id"), entry.alias("entry"))
    docs = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "entry"))).alias("e"))  # at most 50 ids a document
    return docs.select(F.format_string("https://maps.example.com/%05d.xml", "part").alias("url"), F.concat(F.lit("<urlset>"), F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.lit("</urlset>")).alias("xml"))


_map = f"""SELECT page_id, {NORM_URL} AS url, CASE WHEN page_id % 2 = 0 THEN 'N ' || page_id END AS news, CASE WHEN page_id % 3 <> 0 THEN strftime({AS_OF_SQL} - to_days((page_id % 5)::INT), '%Y-%m-%d') END AS published FROM pages WHERE url IS NOT NULL AND (page_id % 3 = 0 OR page_id % 5 <= 3)"""
_slugt = r"trim(regexp_replace(regexp_replace(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')[-1], '[-_]+', ' ', 'g'), '\s+', ' ', 'g'))"
query("src06_sitemap", f"SELECT url, coalesce(news, {_slugt}) AS title, published FROM ({_map}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")(
    lambda s, d: FE.sitemap_urls(sitemap_documents(s, d), as_of()).select("url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published"))
)


def _index(s, d):
    docs = sitemap_documents(s, d)
    xml = F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.sort_array(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>"))
    return docs.groupBy(F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(50)).alias("g")).agg(xml.alias("xml")).select(F.format_string("https://maps.example.com/index%d.xml", "g").alias("url"), "xml")


query("src07_sitemap_index", f"SELECT url FROM ({_map}) GROUP BY url")(
    lambda s, d: FE.expand_sitemaps(_index(s, d).select("url"), _index(s, d).unionByName(sitemap_documents(s, d)), as_of(), limit=1_000_000).select("url").distinct()
)
_paths = ", ".join(f"'{p}'" for p in FE.SITEMAP_PATHS)
query("src08_sitemap_candidates", f"SELECT origin, origin || p AS url FROM (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages WHERE url IS NOT NULL), (SELECT unnest([{_paths}]) AS p)")(lambda s, d: FE.sitemap_candidates(P(s, d)))


def long_links(s, d):
    """Pages whose links get longer texts and dated paths, so that some score as articles."""
    page = F.regexp_replace("html", r'<a href="/([^"]*)">([^<]*)</a>', '<a href="/news/2024/05/a-long-and-dated-slug-$1">$2, a headline of more than twenty-four letters</a>')
    return P(s, d).where("url is not null").select("page_id", "url", page.alias("html"))


query("src09_article_links")(lambda s, d: HT.article_links(long_links(s, d)))
query("src10_discovered_links")(
    lambda s, d: (lambda h: HT.discovered_links(h.where("page_id % 2 = 0").select("page_id", "url", "title"), h))(HT.article_links(long_links(s, d)))
)
query("src11_merge_lists", "SELECT url, CASE WHEN min(k) = 0 THEN 'feed' ELSE 'map' END AS origin FROM (SELECT url, 0 AS k FROM articles WHERE id % 2 = 0 UNION ALL SELECT url, 1 FROM articles WHERE id % 3 = 0) GROUP BY url")(
    lambda s, d: FE.merge_discovered(A(s, d).where("id % 2 = 0").select("url", F.lit("feed").alias("origin")), A(s, d).where("id % 3 = 0").select("url", F.lit("map").alias("origin")))
)


def forum_pages(s, d):
    cm = X.comments(s, d)
    post = F.concat(
        F.lit('<article class="message message--post"><div class="message-name"><a class="username">'), F.coalesce("author", F.lit("x")), F.lit('</a></div><div class="message-body"><div class="bbWrapper">'),
        F.lit('<div class="bbCodeBlock--quote">quoted words</div>'), _xml(c("body")), F.lit('</div></div><a class="reactionsBar-link">'), c("reactions").cast("string"), F.lit(" likes</a></article>"),
    )
    docs = cm.groupBy("thread", "page").agg(F.sort_array(F.collect_list(F.struct("order", post.alias("post")))).alias("p"))  # three posts a page
    pager = F.concat(F.lit('<div class="pageNav"><a href="/t/page-'), (c("page") + 1).cast("string"), F.lit('">next</a></div>'))
    return docs.select("thread", "page", F.concat(F.lit("<html><body>"), F.array_join(F.transform("p", lambda x: x["post"]), ""), pager, F.lit("</body></html>")).alias("html"))


query("src12_thread_posts", f"""SELECT thread, page, "order", author, substr({SQZ.format('body')}, 1, 1200) AS body, reactions, page = 1 AND "order" = 0 AS is_op FROM comments WHERE length({SQZ.format('body')}) > 10""")(
    lambda s, d: HT.thread_posts(forum_pages(s, d)).select("thread", "page", "order", "author", "body", "reactions", "is_op")
)
query("src13_thread_pages", "SELECT DISTINCT thread, '/t/page-' || (page + 1) AS href FROM comments")(lambda s, d: HT.thread_pages(forum_pages(s, d)))


def comment_trees(s, d):
    """A tree per block of 50 pages of a thread: turns 0, 3, 6.. are roots, each with the next turn as reply, which has the one after."""
    cm = X.comments(s, d).select("thread", "page", "order", "author", F.when(c("thread") % 7 == 3, F.when(c("order") == 1, "[deleted]").otherwise(c("body"))).otherwise(c("body")).alias("body"), "reactions")
    by = cm.groupBy("thread", "page").agg(*[F.max(F.when(c("order") == k, F.struct("author", "body", "reactions"))).alias(f"c{k}") for k in range(3)])

    def node(k, replies):
        r = F.when(replies.isNotNull(), F.struct(F.struct(F.array(replies).alias("children")).alias("data"))) if replies is not None else F.lit(None).cast("string")
        return F.when(c(f"c{k}").isNotNull(), F.struct(F.lit("t1").alias("kind"), F.struct(c(f"c{k}.author").alias("author"), c(f"c{k}.body").alias("body"), c(f"c{k}.reactions").alias("score"), r.alias("replies")).alias("data")))

    nested = by.select("thread", "page", node(0, node(1, node(2, None))).alias("n"))
    docs = nested.groupBy("thread", F.floor((c("page") - 1) / 50).alias("block")).agg(F.sort_array(F.collect_list(F.struct("page", F.to_json("n").alias("j")))).alias("l"))
    return docs.select(F.concat_ws("/", "thread", "block").alias("thread"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("children"))


query("src14_comment_tree", f"""WITH k AS (SELECT thread, thread || '/' || (page - 1) // 50 AS block, author, CASE WHEN thread % 7 = 3 AND "order" = 1 THEN '[deleted]' ELSE body END AS b, reactions, page, "order" AS o FROM comments),
v AS (SELECT * FROM k WHERE {SQZ.format('b')} NOT IN ('', '[deleted]') AND NOT (thread % 7 = 3 AND o = 2)) SELECT block AS thread, author, substr({SQZ.format('b')}, 1, 900) AS body, reactions, o + 1 AS depth, (row_number() OVER (PARTITION BY block ORDER BY page, o) - 1)::INT AS "order" FROM v""")(
    lambda s, d: JS.comment_tree(comment_trees(s, d)).select("thread", "author", "body", "reactions", "depth", "order")
)


def listing_pages(s, d):
    """A listing row and a comment with a reply per article, made of its title, excerpt, source and time."""
    entry = lambda body, points: (F.lit('<div class="entry"><div class="usertext-body"><div class="md">'), _xml(c(body)), F.lit(f'</div></div><span class="score unvoted" title="'), points, F.lit('"></span></div>'))  # noqa: E731, F541
    thing = lambda author: (F.lit('<div class="thing" data-type="comment" data-author="'), author, F.lit('">'))
    return A(s, d).select(
        c("id").alias("page_id"),
        F.concat(
            F.lit('<div class="thing" data-type="link"><a class="title" href="'), c("url"), F.lit('">'), _xml(c("title")), F.lit('</a><a class="author">'), c("source_id"), F.lit('</a><time datetime="'),
            F.date_format("created_at", "yyyy-MM-dd"), F.lit('"></time></div>'), *thing(c("source_id")), *entry("raw_excerpt", (c("id") % 60).cast("string")), F.lit('<div class="child">'),
            *thing(F.when(c("id") % 5 == 0, "[deleted]").otherwise(c("language"))), *entry("title", F.lit("x")), F.lit("</div></div></div>"),
        ).alias("html"),
    )


query("src15_listing_rows", f"SELECT id AS page_id, 0 AS pos, {SQZ.format('title')} AS title, url AS href, source_id AS author, strftime(created_at, '%Y-%m-%d') AS published FROM articles")(
    lambda s, d: HT.listing_rows(listing_pages(s, d)).select("page_id", "pos", "title", "href", "author", "published")
)
_two_comments = f"""SELECT id AS page_id, 1 AS depth, source_id AS author, {SQZ.format('raw_excerpt')} AS body, (id % 60)::INT AS reactions FROM articles UNION ALL
SELECT id, 2, language, {SQZ.format('title')}, 0 FROM articles WHERE id % 5 <> 0"""
query("src16_comment_rows", f"""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY depth) - 1)::INT AS "order", depth, author, substr(body, 1, 900) AS body, reactions FROM ({_two_comments}) WHERE length(body) >= 20""")(
    lambda s, d: HT.comment_rows(listing_pages(s, d)).drop("score")
)
_jsonl = lambda s, d: X.comments(s, d).groupBy(F.concat_ws("/", "thread", F.floor((c("page") - 1) / 50)).alias("thread")).agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("page", "order", "author", "body", c("reactions").alias("score")))), lambda x: F.struct(x["author"].alias("author"), x["body"].alias("body"), x["score"].alias("score"))).alias("data"))).alias("json"))
query("src17_comment_list", f"""SELECT thread, pos, author, body, score FROM (SELECT thread || '/' || (page - 1) // 50 AS thread, (row_number() OVER (PARTITION BY thread, (page - 1) // 50 ORDER BY page, "order", author) - 1)::INT AS pos, author, {SQZ.format('body')} AS body, reactions AS score FROM comments) WHERE pos > 0 AND length(body) > 20""")(
    lambda s, d: JS.comment_list(_jsonl(s, d))
)


def state_pages(s, d):
    obj = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("//m.example.com/a/"), c("id").cast("string")).alias("url"), F.concat(F.lit("A headline no "), c("id").cast("string")).alias("title")).alias("x"))).alias("list"), F.struct(c("raw_excerpt").alias("articleBody")).alias("story")))
    ld = F.to_json(F.struct(F.array(F.struct(F.lit("NewsArticle").alias("@type"), c("title").alias("headline"), F.coalesce("raw_excerpt", F.lit("")).alias("articleBody"), F.date_format("created_at", "yyyy-MM-dd").alias("datePublished"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("struct<contentUrl:string>").alias("caption")), F.struct(F.lit("VideoObject").alias("@type"), F.lit(None).cast("string").alias("headline"), F.lit(None).cast("string").alias("articleBody"), F.lit(None).cast("string").alias("datePublished"), c("source_id").alias("name"), c("title").alias("description"), F.when(c("image_url").isNotNull(), F.struct(c("image_url").alias("contentUrl"))).alias("caption"))).alias("@graph")))
    obj, ld = (F.replace(x, F.lit("</"), F.lit("<\\/")) for x in (obj, ld))  # else a text could close its script
    return A(s, d).select(c("id").alias("page_id"), F.concat(F.lit("<html><script>window.blockRenderData = "), obj, F.lit('; f({"a":1});</script><script type="application/ld+json">'), ld, F.lit('</script><script>window.__INITIAL_STATE__ = '), obj, F.lit(";</script></html>")).alias("html"))


query("src18_embedded_list", "SELECT id AS page_id, '//m.example.com/a/' || id AS url, 'A headline no ' || id AS title FROM articles")(lambda s, d: JS.embedded_articles(state_pages(s, d)).select("page_id", "url", "title"))
query("fn26_json_ld", f"SELECT id AS page_id, {SQZ.format(_ent.format(chr(39).join(['regexp_replace(raw_excerpt, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')'])))} AS body, nullif(trim(title), '') AS title, strftime(created_at, '%Y-%m-%d') AS published FROM articles")(
    lambda s, d: JS.json_ld_articles(state_pages(s, d)).select("page_id", "body", "title", "published")
)
query("fn27_state_body", f"SELECT id AS page_id, {_snip} AS body FROM articles WHERE trim(raw_excerpt) <> ''")(lambda s, d: JS.state_bodies(state_pages(s, d)))
query("fn28_json_ld_video", "SELECT id AS page_id, source_id AS title, CASE WHEN id % 3 <> 0 THEN 'https://img.example.com/' || (id % 200) END AS caption_url, nullif(trim(title), '') AS description FROM articles")(lambda s, d: JS.json_ld_video(state_pages(s, d)).drop("published"))
_hot = lambda s, d: A(s, d).groupBy(F.floor(c("id") / 20).alias("feed")).agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("id", "title", "url"))), lambda x: F.struct(x["id"].cast("string").alias("id"), x["title"].alias("title"), x["url"].alias("url"), F.struct(F.when(x["id"] % 2 == 0, F.concat(x["url"], F.lit("?l"))).alias("url")).alias("link_info"))).alias("data"))).alias("json"))
query("src19_hot_list", "SELECT id::VARCHAR AS id, title, CASE WHEN id % 2 = 0 THEN url || '?l' ELSE url END AS url FROM articles WHERE title <> ''")(lambda s, d: JS.hot_list(_hot(s, d)).select("id", "title", "url"))
_cards = lambda s, d: A(s, d).groupBy(F.floor(c("id") / 20).alias("feed")).agg(F.to_json(F.struct(F.array(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("id", "title", "url"))), lambda x: F.struct(F.when(x["id"] % 5 == 0, "ad").otherwise("article").alias("type"), x["id"].cast("string").alias("id"), x["title"].alias("title"), x["url"].alias("url"))).alias("cards"))).alias("sections"))).alias("json"))
query("src20_channel_cards", "SELECT id // 20 AS feed, id::VARCHAR AS id, url, title FROM articles WHERE id % 5 <> 0")(lambda s, d: JS.channel_cards(_cards(s, d)).select("feed", "id", "url", "title"))
_tree = lambda s, d: A(s, d).select("id", F.concat(F.lit('{"sections":[{"subSections":[{"cards":[{"type":"Gem","id":"x"},{"subCards":[{"type":"Gem","gemElementMetadata":{"isSeedElement":true},"id":"'), c("source_id"), c("id").cast("string"), F.lit(', '), c("language"), F.lit('"}]}]}]}]}')).alias("json"))
query("src21_card_tree", "SELECT id, unnest([source_id || id, language]) AS article_id FROM articles")(lambda s, d: JS.card_ids(_tree(s, d), "Gem").select("id", "article_id"))
_detail = lambda s, d: A(s, d).select("id", F.to_json(F.struct("title", F.concat(F.lit("<p>"), _xml(c("raw_excerpt")), F.lit("</p>")).alias("body"), F.array(F.struct(c("source_id").alias("name"))).alias("authors"), F.array(F.struct(c("image_url").alias("url"))).alias("imageResources"))).alias("json"))
query("src22_detail", f"SELECT id, title, {_snip} AS raw_content, source_id AS author, image_url FROM articles")(lambda s, d: JS.detail_article(_detail(s, d)).select("id", "title", "raw_content", "author", "image_url"))
_repos = lambda s, d: A(s, d).select(c("id").alias("page_id"), F.concat(F.lit('<article class="Box-row"><h2><a href="/o/r'), c("id").cast("string"), F.lit('">o / r'), c("id").cast("string"), F.lit('</a></h2><p>'), _xml(c("title")), F.lit('</p><span itemprop="programmingLanguage">'), c("language"), F.lit('</span><a href="/o/r/stargazers">1,2</a><span>30 stars today</span></article>')).alias("html"))
query("src23_repositories", f"SELECT id AS page_id, 'o/r' || id AS name, '/o/r' || id AS href, {SQZ.format('title')} || chr(10) || 'Language: ' || language || chr(10) || 'Stars: 1,2' || chr(10) || 'Today: 30' AS raw_content FROM articles")(
    lambda s, d: HT.repository_rows(_repos(s, d)).select("page_id", "name", "href", "raw_content")
)
query("src25_captions", f"SELECT id, {SQZ.format('title')} || ' end' AS vtt, trim({SQZ.format('title')} || ' & it''s') AS timed FROM articles WHERE title <> ''")(
    lambda s, d: A(s, d).where("title <> ''").select("id", LG.vtt_text(F.concat(F.lit("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<b>"), "title", F.lit("</b>\n\n2\n00:00:03.000 --> 00:00:04.000\nend\n"))).alias("vtt"),
        LG.timed_text(F.concat(F.lit('<t><text start="0">'), _xml(c("title")), F.lit("</text><text> &amp;amp; it&amp;#39;s</text></t>"))).alias("timed"))
)
query("fn29_page_metadata")(lambda s, d: HT.page_metadata(P(s, d)))
query("fn30_page_body")(lambda s, d: HT.page_bodies(P(s, d)))
query("fn30_dense_body")(lambda s, d: HT.dense_bodies(P(s, d)))
query("fn31_profile_body")(
    lambda s, d: HT.profile_bodies(P(s, d).where("url is not null"), s.createDataFrame([("cheap-pills.example.com", ["article"], [".ad"]), ("spam-farm.example.org", ["body"], ["nav"])], "domain string, content_selectors array<string>, remove_selectors array<string>"))
)
query("fn33_site_detect", r"SELECT page_id, nullif(regexp_extract(regexp_extract(html, '(?i)<html\b[^>]*>', 0), '(?i)\blang\s*=\s*[" + '"' + r"''](.*?)[" + '"' + r"'']', 1), '') AS lang, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS title, url AS canonical, false AS is_feed FROM pages")(
    lambda s, d: P(s, d).select("page_id", *[v.alias(k) for k, v in HT.site_facts(c("html"), c("url")).items() if k in ("lang", "title", "canonical", "is_feed")])
)


def garbled(s, d):
    """Articles whose texts were escaped and whose UTF-8 was read as Latin-1, every third each."""
    bad = lambda x: F.when(c("id") % 3 == 0, F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")).when(c("id") % 3 == 1, _xml(x)).otherwise(x)
    return A(s, d).select("id", *[bad(c(f)).alias(f) for f in HT.TEXT_FIELDS])


query("fn14_repair_text")(lambda s, d: HT.with_repaired(garbled(s, d)))
