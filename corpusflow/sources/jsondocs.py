"""JSON documents: comment trees, hot lists, channel feeds, card trees and embedded state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.classify import comment_score
from corpusflow.functions.text import html_to_text, squeeze, trimmed
from corpusflow.runtime import text_batches

_LEAF = "struct<kind:string,data:struct<author:string,body:string,score:int,replies:string>>"
MAX_DEPTH = 3


def comment_tree(threads: DataFrame, tree: str = "children", key: str = "thread") -> DataFrame:
    """A comment tree flattened in pre-order to three levels; deleted comments go with their replies.

    Each level is one ``posexplode`` that carries the path of positions; the order
    number is the rank of the path among the comments that stay.
    """
    node = lambda c: F.from_json(c, f"array<{_LEAF}>")
    level = threads.select(F.col(key).alias("thread"), F.posexplode(node(F.col(tree))).alias("p", "n")).select("thread", F.array("p").alias("path"), "n", F.lit(1).alias("depth"))
    out = None
    for depth in range(1, MAX_DEPTH + 1):
        body = squeeze(F.col("n.data.body"))
        good = level.where((F.col("n.kind") == "t1") & (body != "") & ~body.isin("[deleted]", "[removed]"))
        rows = good.select("thread", "path", "depth", F.coalesce("n.data.author", F.lit("unknown")).alias("author"), body.alias("body"), F.coalesce("n.data.score", F.lit(0)).alias("reactions"))
        out = rows if out is None else out.unionByName(rows)
        if depth < MAX_DEPTH:
            replies = F.get_json_object(F.col("n.data.replies"), "$.data.children")
            level = good.select("thread", "path", F.posexplode(node(replies)).alias("p", "n")).select(
                "thread", F.concat("path", F.array("p")).alias("path"), "n", F.lit(depth + 1).alias("depth")
            )
    place = F.row_number().over(Window.partitionBy("thread").orderBy("path")) - 1
    out = out.withColumn("order", place)
    bonus = F.when(F.col("depth") == 1, 0.8).otherwise(0.2)
    score = comment_score(F.col("body"), F.col("reactions"), F.col("depth"), F.col("order") + 1) + bonus
    return out.select("thread", "author", F.substring("body", 1, 900).alias("body"), "reactions", "depth", "order", score.alias("score"))


def hot_list(docs: DataFrame, column: str = "json") -> DataFrame:
    """Items of a hot list with a URL and a title; the linked URL comes first."""
    item = "struct<id:string,title:string,url:string,link_info:struct<url:string>,media_info:struct<chl_name:string>,publish_time:string,desc:string>"
    parsed = F.from_json(F.col(column), f"struct<data:array<{item}>,newslist:array<{item}>>")
    rows = docs.select(F.posexplode(F.coalesce(parsed["data"], parsed["newslist"])).alias("pos", "i"))
    return rows.select(
        "pos", "i.id", "i.title", F.coalesce("i.link_info.url", "i.url").alias("url"), F.col("i.media_info.chl_name").alias("media"), "i.publish_time", "i.desc"
    ).where("coalesce(url, '') <> '' and coalesce(title, '') <> ''")


def channel_cards(docs: DataFrame, column: str = "json", key: str = "feed") -> DataFrame:
    """Article cards of a channel feed, the first of each id kept, in order."""
    card = "struct<type:string,id:string,url:string,title:string,abstract:string,provider:struct<name:string>,publishedDateTime:string>"
    parsed = F.from_json(F.col(column), f"struct<sections:array<struct<cards:array<{card}>>>>")
    sections = docs.select(F.col(key).alias("feed"), F.posexplode(parsed["sections"]).alias("s", "section"))
    cards = sections.select("feed", "s", F.posexplode("section.cards").alias("c", "card")).where("card.type = 'article' and coalesce(card.id, '') <> '' and coalesce(card.url, '') <> ''")
    first = Window.partitionBy("feed", "card.id").orderBy("s", "c")
    cards = cards.withColumn("n", F.row_number().over(first)).where("n = 1")
    return cards.select("feed", "s", "c", "card.id", "card.url", "card.title", F.col("card.provider.name").alias("provider"))


def comment_list(docs: DataFrame, column: str = "json", key: str = "thread") -> DataFrame:
    """Comments of an archive listing; the first entry is the post itself, short bodies are dropped."""
    parsed = F.from_json(F.col(column), "struct<data:array<struct<author:string,body:string,score:int>>>")
    rows = docs.select(F.col(key).alias("thread"), F.posexplode(parsed["data"]).alias("pos", "i")).where("pos > 0")
    return rows.select("thread", "pos", "i.author", squeeze(F.col("i.body")).alias("body"), "i.score").where("length(body) > 20")


def detail_article(docs: DataFrame, column: str = "json", key: str = "id") -> DataFrame:
    """An article row from a detail document: body as text, first author, first image."""
    parsed = F.from_json(F.col(column), "struct<title:string,body:string,authors:array<struct<name:string>>,imageResources:array<struct<url:string>>,publishedDateTime:string>")
    first = lambda a, f: F.try_element_at(F.coalesce(parsed[a][f], F.array().cast("array<string>")), F.lit(1))
    return docs.select(key, parsed["title"].alias("title"), html_to_text(parsed["body"]).alias("raw_content"), first("authors", "name").alias("author"), first("imageResources", "url").alias("image_url"), parsed["publishedDateTime"].alias("published_at"))


def balanced_object(text: str, marker: str) -> str | None:
    """The JSON object that follows a marker, cut where its braces close."""
    at = text.find(marker)
    at = text.find("{", at) if at >= 0 else -1
    if at < 0:
        return None
    try:
        return text[at : at + json.JSONDecoder().raw_decode(text[at:])[1]]
    except (ValueError, RecursionError):
        return None


def parsed_json(text: str | None):
    """The parsed document, or None where it is absent, malformed or nested too deep to parse."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _walk(node, depth: int, most: int, visit) -> None:
    if depth > most:
        return
    if isinstance(node, dict):
        visit(node)
        for value in node.values():
            _walk(value, depth + 1, most, visit)
    elif isinstance(node, list):
        for value in node:
            _walk(value, depth + 1, most, visit)


MEDIA_PREFIXES = ("视频", "图片", "组图", "直播", "广告", "推广")  # fixed values


def embedded_articles(pages: DataFrame, marker: str = "window.blockRenderData", column: str = "html", key: str = "page_id") -> DataFrame:
    """Objects with an article URL and a title anywhere in a page's embedded state, to depth 15."""
    import re

    url_form = re.compile(r"/a/\d+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for page, html in zip(frame["key"], frame["html"], strict=True):
                found = balanced_object(html or "", marker)
                out: list[tuple[str, str]] = []

                def visit(node, out=out):
                    url, title = node.get("url"), node.get("title")
                    if isinstance(url, str) and isinstance(title, str) and url_form.search(url) and len(title) >= 10 and not title.startswith(MEDIA_PREFIXES):
                        out.append((url, title))

                if found:
                    _walk(parsed_json(found), 0, 15, visit)
                rows += [(page, i, u, t) for i, (u, t) in enumerate(dict.fromkeys(out))]
            yield pd.DataFrame(rows, columns=["key", "pos", "url", "title"])

    text_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(column).alias("html")).mapInPandas(run, f"key {kind}, pos int, url string, title string").withColumnRenamed("key", key)


def card_ids(docs: DataFrame, card_type: str, column: str = "json", key: str = "id") -> DataFrame:
    """Ids of the seed card of a type in a card tree of any depth, split at commas; malformed documents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc, text in zip(frame["key"], frame["json"], strict=True):
                cards: list[dict] = []
                stack = [parsed_json(text)]
                while stack:  # in document order, to any depth
                    node = stack.pop()
                    if isinstance(node, list):
                        stack += reversed(node)
                    elif isinstance(node, dict):
                        if node.get("type") == card_type:
                            cards.append(node)
                        stack += [node[name] for name in reversed(("sections", "subSections", "cards", "subCards")) if isinstance(node.get(name), list)]
                if cards:
                    seed = next((c for c in cards if isinstance(c.get("gemElementMetadata"), dict) and c["gemElementMetadata"].get("isSeedElement")), cards[0])
                    rows += [(doc, i, x.strip()) for i, x in enumerate(str(seed.get("id") or "").split(",")) if x.strip()]
            yield pd.DataFrame(rows, columns=["key", "pos", "article_id"])

    text_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(column).alias("json")).mapInPandas(run, f"key {kind}, pos int, article_id string").withColumnRenamed("key", key)


def _ld_nodes(doc, wanted) -> list[dict]:
    """Objects of a JSON-LD document that are ``wanted``: those of lists and ``@graph`` lists, nested as they may be, before the object that holds them."""
    out, left = [], [(doc, False)]
    while left:
        node, opened = left.pop()
        if isinstance(node, list):
            left += [(x, False) for x in reversed(node)]
        elif isinstance(node, dict):
            if not opened and isinstance(node.get("@graph"), list):
                left += [(node, True), (node["@graph"], False)]
            elif wanted(node):
                out.append(node)
    return out


def ld_nodes(pages: DataFrame, wanted, column: str, key: str) -> DataFrame:
    """``key, s, p, v``: the ``wanted`` objects of a page's JSON-LD as variants, in order of scripts and places."""
    scripts = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select(F.col(key).alias("key"), F.posexplode(scripts).alias("s", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [(k, s, p, json.dumps(node)) for k, s, text in frame.itertuples(index=False) for p, node in enumerate(_ld_nodes(parsed_json(text.strip()), wanted))]
            yield pd.DataFrame(found, columns=["key", "s", "p", "node"])

    text_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    found = rows.mapInPandas(run, f"key {kind}, s int, p int, node string")
    return found.select("key", "s", "p", F.try_parse_json("node").alias("v")).where("v is not null")


def _text_at(value: str | Column, path: str) -> Column:
    """The trimmed string at a path of a variant; null if it is blank or no string."""
    there = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(there) == "STRING", F.nullif(trimmed(F.try_variant_get(value, path, "string")), F.lit("")))


def _named(types: tuple[str, ...]) -> Column:
    """Whether ``@type`` of the variant ``v``, a string or a list, names one of ``types``."""
    given = F.coalesce(F.try_variant_get("v", "$['@type']", "array<variant>"), F.array(F.try_variant_get("v", "$['@type']", "variant")))
    return F.coalesce(F.exists(given, lambda t: F.lower(F.try_variant_get(t, "$", "string")).isin(*types)), F.lit(False))


# The article types.
ARTICLE_TYPES = (
    "article", "newsarticle", "reportagenewsarticle", "report", "blogposting", "liveblogposting", "techarticle", "scholarlyarticle",
    "backgroundnewsarticle", "opinionnewsarticle", "analysisnewsarticle", "reviewnewsarticle",
)
VIDEO_TYPES = ("videoobject",)


def json_ld_articles(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """The best JSON-LD article of each page: the longest body, a known type counting one more, the first of equals.

    An article whose body is blank keeps its title, date and image; its ``body`` is empty.
    """
    nodes = ld_nodes(pages, lambda node: isinstance(node.get("articleBody"), str | list), column, key)
    get = lambda *names: F.coalesce(*[_text_at("v", f"$.{n}") for n in names])
    paragraphs = F.try_variant_get("v", "$.articleBody", "array<string>")
    body = F.coalesce(F.array_join(F.transform(paragraphs, lambda x: html_to_text(x)), "\n\n"), html_to_text(F.try_variant_get("v", "$.articleBody", "string")))
    image = F.coalesce(*[_text_at("v", p) for p in ("$.image", "$.image[0]", "$.image.url", "$.image.contentUrl", "$.image[0].url", "$.image[0].contentUrl")])
    found = nodes.select("key", "s", "p", body.alias("body"), _named(ARTICLE_TYPES).alias("known"), get("headline", "name").alias("title"), get("datePublished", "dateCreated", "dateModified").alias("published"), image.alias("image_url"))
    best = F.max_by(F.struct("body", "title", "published", "image_url"), F.struct(F.length("body") + F.col("known").cast("int"), -F.col("s"), -F.col("p")))
    return found.groupBy(F.col("key").alias(key)).agg(best.alias("b")).select(key, "b.*")


def json_ld_video(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """Video objects of a page's JSON-LD with the URL of their first caption that has one: a string, or its ``url``, then ``contentUrl``."""
    nodes = ld_nodes(pages, lambda node: "@type" in node, column, key).where(_named(VIDEO_TYPES))
    captions = F.coalesce(F.try_variant_get("v", "$.caption", "array<variant>"), F.array(F.try_variant_get("v", "$.caption", "variant")))
    urls = F.transform(captions, lambda x: F.coalesce(_text_at(x, "$"), _text_at(x, "$.url"), _text_at(x, "$.contentUrl")))
    first = lambda *names: F.coalesce(*[_text_at("v", f"$.{n}") for n in names])
    title, published = first("headline", "name", "alternativeHeadline"), first("uploadDate", "datePublished", "dateCreated", "dateModified")
    return nodes.select(F.col("key").alias(key), title.alias("title"), first("description").alias("description"), published.alias("published"), F.get(F.filter(urls, lambda u: u.isNotNull()), F.lit(0)).alias("caption_url"))


# Where pages keep their state.
STATE_FORMS = (
    r'(?is)<script[^>]+id="__NEXT_DATA__"[^>]*>(.*?)</script>',
    r"(?is)window\.__PRELOADED_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
    r"(?is)window\.__APOLLO_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
    r"(?is)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>",
)


def state_blobs(html: Column) -> Column:
    """The embedded states of a page as JSON texts, in the order of the forms."""
    return F.filter(F.array(*[F.trim(F.regexp_extract(html, p, 1)) for p in STATE_FORMS]), lambda t: t != "")


def state_bodies(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """The longest ``articleBody`` or ``bodyText``, to depth 12, in the first of each page's states that holds one; malformed states are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for page, text in ((page, text) for page, texts in zip(frame["key"], frame["state"], strict=True) for text in texts):
                if out and out[-1][0] == page:
                    continue
                bodies: list[str] = []

                def visit(node, bodies=bodies):
                    for name in ("articleBody", "bodyText"):
                        value = node.get(name)
                        value = "\n\n".join(v for v in value if isinstance(v, str)) if isinstance(value, list) else value
                        if isinstance(value, str) and value.strip():
                            bodies.append(value)

                _walk(parsed_json(text), 0, 12, visit)
                if bodies:
                    out.append((page, max(bodies, key=len)))
            yield pd.DataFrame(out, columns=["key", "body"])

    text_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), state_blobs(F.col(column)).alias("state")).where("size(state) > 0")
    return rows.mapInPandas(run, f"key {kind}, body string").select(F.col("key").alias(key), html_to_text(F.col("body")).alias("body"))
