"""URL expressions: parts, domains, normalising, gates, link scores and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import let

# The tracking parameters that are dropped.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "ref")


def domain(url: Column) -> Column:
    bare = F.regexp_replace(F.lower(url), r"^https?://(www\.)?", "")
    return F.regexp_replace(bare, r"[/?#].*$", "")


def host(url: Column) -> Column:
    """Lower-case host without ``www.`` and port; empty if there is none."""
    h = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(h, r"^www\.", "")


def path(url: Column) -> Column:
    p = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def normalize_url(url: Column, strip_slash: bool = True) -> Column:
    """Fragment and tracking parameters dropped, trailing slashes too; what is no URL stays."""

    def made(u: Column) -> Column:
        front = F.regexp_extract(u, r"^([^?#]*)", 1)
        query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
        kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING))
        if strip_slash:
            front = F.regexp_replace(front, r"/+$", "")
        front = F.regexp_replace(front, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$", "$1/")
        out = let(kept, lambda k: F.concat(front, F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(F.lit(""))))
        return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), out).otherwise(u)

    return let(url, made)


def _ipv4(h: Column) -> list[Column]:
    return [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]


def is_public_host(h: Column) -> Column:
    """False for local names, private or reserved IPv4 addresses, number-like hosts and bracketed addresses."""
    a, b, c, d = _ipv4(h)
    is_v4 = a.isNotNull() & (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    # Address ranges that are not public.
    blocked = (
        a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224)
    )
    local = (h == "") | (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.contains("%")
    odd = F.replace(h, F.lit("."), F.lit("")).rlike(r"^\d+$") | h.rlike(r"(^|\.)0x")
    return ~local & F.when(is_v4, ~blocked).when(h.startswith("["), F.lit(False)).otherwise(~odd)


def public_url(url: Column) -> Column:
    """The normalised URL if it is public http or https, else null."""
    return let(url, lambda u: F.when(F.lower(u).rlike(r"^https?://") & let(host(u), is_public_host), normalize_url(u)))


def is_junk(url: Column) -> Column:
    """Media pages, aggregator pages without an article id, and data pages of one publisher."""

    def test(h: Column, p: Column) -> Column:
        media = p.rlike(r"/(videos?|audio|podcasts?)/")
        msn = ((h == "msn.com") | h.endswith(".msn.com")) & ~p.rlike(r"/(ar|gm)-[a-z0-9]+")
        data = p.rlike(r"^/(quote|markets|professional|profile)\b") | p.rlike("/newsletters/") | p.rlike("^/graphics/")
        return media | msn | (((h == "bloomberg.com") | h.endswith(".bloomberg.com")) & data)

    return let(F.struct(host(url).alias("h"), path(url).alias("p")), lambda s: test(s["h"], s["p"]))


def is_skipped_page(url: Column) -> Column:
    """Landing pages of publications and vertical short videos."""
    h, p = host(url), path(url)
    brand = (h == "profiles.yahoo.com") & p.rlike(r"^/brands(/|$)")
    return brand | (h.isin("cnn.com", "edition.cnn.com") & p.rlike(r"/video/") & p.rlike(r"(^|-)vrtc(-|$)"))


def link_score(url: Column, title: Column, source_url: Column) -> Column:
    """How much a link looks like an article of its source; 0 for other hosts, utility pages and social links."""

    def score(v: Column) -> Column:
        p, parts, h, sh = v["p"], v["parts"], v["h"], v["sh"]
        slug = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lit(""))
        other = F.when(v["yahoo"], ~h.endswith("yahoo.com")).otherwise(h != sh)
        utility = p.rlike(r"/(tag|tags|author|login|subscribe|search|category|privacy|about|contact)\b")
        points = (
            F.when(p.rlike(r"/20\d{2}[/-]") | p.rlike(r"/\d{4}/\d{2}/"), 5).otherwise(0)
            + F.when(p.rlike(r"/(news|world|business|technology|tech|article|story|politics|markets)\b"), 4).otherwise(0)
            + F.when((F.length(slug) >= 24) & slug.rlike("[-_]"), 4).otherwise(0)
            + F.when(F.size(parts) >= 2, 1).otherwise(0)
        )
        return F.when(other | utility | v["social"], 0).otherwise(points + v["title"])

    n = F.length(title)
    facts = F.struct(
        path(url).alias("p"), F.filter(F.split(path(url), "/"), lambda s: s != "").alias("parts"), host(url).alias("h"), host(source_url).alias("sh"),
        F.lower(source_url).rlike(r"^https?://profiles\.yahoo\.com").alias("yahoo"), F.lower(url).rlike(r"facebook|twitter|x\.com|linkedin|mailto:|javascript:").alias("social"),
        (F.when(n >= 24, 3).otherwise(0) + F.when(n >= 50, 2).otherwise(0)).alias("title"),
    )
    return let(facts, score)


def fetcher_key(url: Column, kind: Column) -> Column:
    """Which reader handles a source, by host and type."""
    h = host(url)
    is_of = lambda d: (h == d) | h.endswith("." + d)
    return (
        F.when(is_of("github.com") & path(url).startswith("/trending"), "github_trending")
        .when(is_of("reddit.com"), "reddit").when(is_of("voz.vn"), "voz").when(is_of("msn.com"), "msn").when(is_of("qq.com"), "qq")
        .when(is_of("sohu.com"), "sohu").when(kind == "youtube", "youtube").when(kind == "web", "web").otherwise("rss")
    )


def video_id(url: Column) -> Column:
    return F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})", 1)


def subreddit(url: Column) -> Column:
    return F.regexp_extract(url, r"/r/([A-Za-z0-9_]+)", 1)


def post_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/comments/([a-z0-9]+)", 1)


def article_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/(?:ar|gm)-([A-Za-z0-9]+)", 1)


def locale(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://[^/]+/([A-Za-z]{2}-[A-Za-z]{2})(?:/|$)", 1))


def block_pattern(c: Column) -> Column:
    """A block-list pattern in its stored form: lower case, without scheme, ``www.`` and trailing slashes."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(out, r"^www\.", ""), r"/+$", "")


_PARTS = r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def without_dots(url: Column) -> Column:
    """``.`` and ``..`` segments of the path are resolved."""
    path = F.regexp_extract(url, _PARTS, 2)
    kept = F.aggregate(
        F.slice(F.split(path, "/"), 2, F.length(path) + 1),
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    ends = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    made = F.concat(F.regexp_extract(url, _PARTS, 1), F.lit("/"), F.array_join(ends, "/"), F.regexp_extract(url, _PARTS, 3))
    return F.when(path.rlike(r"/\.\.?(/|$)"), made).otherwise(url)


def resolved(to: Column, base: Column) -> Column:
    """``to`` as a URL without fragment, seen from the page ``base``; null for an empty one, other schemes, or a base without ``://``."""
    return let(base, lambda b: let(let(F.regexp_replace(to, r"(?s)#.*$", ""), lambda t: _joined(t, b)), without_dots))


def _joined(to: Column, base: Column) -> Column:
    origin, path = F.regexp_extract(base, _PARTS, 1), F.regexp_extract(base, _PARTS, 2)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(to.rlike(_SCHEME + "//"), to)
        .when(to.rlike(_SCHEME) | (to == "") | (origin == ""), None)
        .when(to.startswith("//"), F.concat(F.regexp_extract(origin, r"^(.*?)//", 1), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .otherwise(F.concat(origin, folder, to))
    )
