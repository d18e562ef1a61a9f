"""Feeds and sitemaps: scans over tables of XML text, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.dates import normalize_date
from corpusflow.functions.text import html_to_text, let, squeeze
from corpusflow.functions.url import host, is_junk, public_url, resolved
from corpusflow.operators.merge import first_per

# Places where sites keep their sitemaps.
SITEMAP_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/news-sitemap.xml", "/news_sitemap.xml", "/sitemap_news.xml", "/post-sitemap.xml", "/sitemaps/news.xml",
    "/sitemap-news.xml", "/google-news-sitemap.xml", "/sitemap-google-news.xml",
)


def element(xml: Column, name: str) -> Column:
    """Text of the first element of that name, CDATA opened and entities decoded; empty if absent."""
    raw = F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)

    def decoded(t: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    opened = lambda t: F.when(t.contains("<![CDATA["), F.regexp_replace(t, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")).otherwise(t)
    return let(let(raw, opened), lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))  # most parts need neither pass


def first_text(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in cols])


def elements(table: DataFrame, xml: str, tag: str) -> DataFrame:
    """One row per element, with its position."""
    found = F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), F.lit(0))
    return table.select("*", F.posexplode(found).alias("pos", "__part"))


def read_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Elements of XML files through the XML reader; broken records keep their text."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreNamespace", "true").load(path)


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of feeds with a title and a link; guid falls back to the link, the date and the content to their kin."""
    p = F.col("__part")
    rows = elements(feeds, xml, "item").select(
        *[c for c in feeds.columns if c != xml], "pos", first_text(element(p, "title")).alias("title"), first_text(element(p, "link")).alias("link"),
        first_text(element(p, "guid")).alias("guid"), first_text(*[element(p, n) for n in ("pubDate", "dc:date", "published", "updated")]).alias("pub_date"),
        first_text(element(p, "creator"), element(p, "dc:creator")).alias("creator"), html_to_text(element(p, "description")).alias("snippet"),
        F.coalesce(*[F.nullif(element(p, n), F.lit("")) for n in ("encoded", "content:encoded", "description")], F.lit("")).alias("content"),
        F.nullif(F.regexp_extract(p, r"<enclosure\b[^>]*\burl=[\"']([^\"']*)", 1), F.lit("")).alias("enclosure_url"),
    )
    return rows.where("title is not null and link is not null").withColumn("guid", F.coalesce("guid", "link"))


def feed_diagnostics(xml: Column) -> Column:
    """The start of a document that holds no items, without scripts and styles."""
    bare = F.regexp_replace(F.coalesce(xml, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.when(~xml.rlike(r"<item[\s>]"), F.substring(squeeze(bare), 1, 240))


def recovered_url(link: Column, content: Column, source_url: Column) -> Column:
    """The article's own URL out of an aggregator's description."""
    aggregator = let(host(source_url), lambda h: (h == "hnrss.org") | h.endswith(".hnrss.org")) | link.contains("news.ycombinator.com/item")
    found = F.regexp_extract(html_to_text(content), r"(?i)Article URL:\s*(https?://\S+?)(?=\s+Comments URL:|\s+Points:|\s+# Comments:|$)", 1)
    return F.when(aggregator, F.coalesce(public_url(F.nullif(found, F.lit(""))), link)).otherwise(link)


def discover(items: DataFrame, source_key: str, source_url: Column, most: int = 20) -> DataFrame:
    """The first items of each source as articles to fetch: URL recovered, junk dropped, image from the enclosure or the content."""
    url = public_url(recovered_url(F.col("link"), F.col("content"), source_url))
    image = F.coalesce("enclosure_url", F.nullif(F.regexp_extract("content", r"(?i)<img[^>]+src=[\"']([^\"']+)", 1), F.lit("")))
    top = first_per(items, source_key, [F.col("pos"), F.col("link")], most)
    rows = top.select(source_key, url.alias("url"), "title", F.col("guid").alias("external_id"), "pub_date", F.to_json(F.struct(image.alias("image"), F.col("creator"))).alias("payload_json"))
    return rows.where(F.col("url").isNotNull() & ~is_junk(F.col("url")))


def title_from_url(url: Column) -> Column:
    parts = F.filter(F.split(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), host(url))
    return F.coalesce(F.nullif(squeeze(F.regexp_replace(F.coalesce(F.try_url_decode(last), last), "[-_]+", " ")), F.lit("")), url)


def absolute(url: Column, base: Column) -> Column:
    """A link seen from its page: relative, rooted and scheme-less ones resolved, ``.`` and ``..`` removed, the fragment dropped; null for an empty one or another scheme."""
    return resolved(F.nullif(F.trim(url), F.lit("")), base)


def sitemap_urls(sitemaps: DataFrame, as_of: Column, max_age_hours: int | None = 72, xml: str = "xml", base: str = "url") -> DataFrame:
    """Entries of sitemaps: news date before lastmod, news title before the slug, old ones dropped, first of a URL kept."""
    p = F.col("__part")
    date = F.coalesce(*[normalize_date(F.nullif(squeeze(element(p, n)), F.lit("")), "Z", as_of) for n in ("news:publication_date", "lastmod")])
    rows = elements(sitemaps, xml, "url").select(
        F.col(base).alias("base"), "pos", public_url(absolute(squeeze(element(p, "loc")), F.col(base))).alias("loc"),
        first_text(element(p, "news:title"), element(p, "title")).alias("news_title"), date.alias("published_at"),
    ).where("loc is not null")
    if max_age_hours is not None:
        rows = rows.where(F.col("published_at").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("published_at") <= max_age_hours * 3600))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("loc").orderBy("base", "pos"))).where("n = 1")
    return first.select("base", F.col("loc").alias("url"), F.coalesce("news_title", title_from_url(F.col("loc"))).alias("title"), "published_at")


def sitemap_children(sitemaps: DataFrame, xml: str = "xml", base: str = "url") -> DataFrame:
    """URLs of the sitemaps that an index names."""
    rows = elements(sitemaps, xml, "sitemap").select(F.col(base).alias("parent"), public_url(absolute(squeeze(element(F.col("__part"), "loc")), F.col(base))).alias("url"))
    return rows.where("url is not null").distinct()


def expand_sitemaps(roots: DataFrame, sitemaps: DataFrame, as_of: Column, max_age_hours: int | None = 72, limit: int = 100) -> DataFrame:
    """Entries of the root sitemaps and of those one index level below, up to ``limit`` a root."""
    own = roots.join(sitemaps, "url")
    below = sitemap_children(own).join(sitemaps, "url").select(F.col("parent").alias("root"), "url", "xml")
    both = own.select(F.col("url").alias("root"), "url", "xml").unionByName(below)
    entries = sitemap_urls(both.select("root", "url", "xml").dropDuplicates(["url"]), as_of, max_age_hours)
    named = entries.join(both.select("root", F.col("url").alias("base")).dropDuplicates(["base"]), "base")
    return first_per(named, "root", [F.col("published_at").desc_nulls_last(), F.col("url")], limit)


def sitemap_candidates(sites: DataFrame, url: str = "url") -> DataFrame:
    origin = F.regexp_extract(public_url(F.col(url)), r"^([a-z]+://[^/?#]*)", 1)
    return sites.select(origin.alias("origin")).where("origin <> ''").distinct().select("origin", F.explode(F.array(*[F.lit(p) for p in SITEMAP_PATHS])).alias("path")).select("origin", F.concat("origin", "path").alias("url"))


def merge_discovered(primary: DataFrame, secondary: DataFrame, key: str = "url") -> DataFrame:
    """Rows of both lists, the primary's where both have a URL."""
    rest = secondary.dropDuplicates([key]).join(primary.select(key).distinct(), key, "left_anti")
    return primary.dropDuplicates([key]).unionByName(rest.select(*primary.columns))
