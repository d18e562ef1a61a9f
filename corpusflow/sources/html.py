"""HTML pages: one Arrow pass builds a small tree per page; everything else is columns."""

from __future__ import annotations

import gc
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.classify import comment_score
from corpusflow.functions.text import squeeze
from corpusflow.functions.url import is_skipped_page, link_score, public_url
from corpusflow.runtime import text_batches
from corpusflow.sources.feeds import absolute

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements without article text, and places of article bodies in order.
NOISE = "script, style, noscript, iframe, svg, form, button, input, textarea, nav, header, footer, aside, .ads, .advertisement, .related, .social, .share, .comment, .comments"
BODIES = (
    'article [itemprop="articleBody"]', '[itemprop="articleBody"]', '[data-testid="article-body"]', "#article-container .caas-body",
    '#article-container [class*="body"]', "#article-container .caas-content-wrapper", "article", ".caas-body", ".maincontent", ".article-detail",
    ".article-content", ".ArticleContent", ".content-detail", ".detail-content", ".news-content", ".entry-content", ".post-content", ".story-body", "main",
)


class Node:
    """An element with its attributes and children (elements or strings)."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        """The text below, white space squeezed."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return " ".join(" ".join(out).split())

    def free(self) -> None:
        """Take the tree apart, so that its elements go without a search for cycles; parts that were removed from it wait for one."""
        stack = [self]
        while stack:
            node = stack.pop()
            stack += [c for c in node.children if isinstance(c, Node)]
            node.parent, node.children = None, []

    def select(self, selector: str) -> list[Node]:
        """Elements that match a comma list of descendant selectors, in document order."""
        chains = compiled(selector)
        return [n for n in self.walk() if n is not self and any(_ends(n, c) for c in chains)]

    def remove(self, selector: str) -> None:
        gone = self.select(selector)
        if gone:
            ids = {id(n) for n in gone}
            for parent in {id(n.parent): n.parent for n in gone}.values():
                parent.children = [c for c in parent.children if id(c) not in ids]


@lru_cache(maxsize=1024)
def compiled(selector: str) -> tuple[tuple[tuple, ...], ...]:
    """The chains of a comma list; each step is ``(tag, classes, id, attributes)`` of a compound selector.

    Compound selectors hold a tag, .class, #id, [attr], [attr="value"] and [attr*="value"].
    """
    chains = []
    for chain in re.split(r",\s*", selector):
        steps = []
        for simple in chain.split():
            tag, classes, own, attrs = None, [], None, []
            for part in re.findall(r"^[\w-]+|\.[\w-]+|#[\w-]+|\[[^\]]+\]", simple):
                if part[0] == ".":
                    classes.append(part[1:])
                elif part[0] == "#":
                    own = part[1:]
                elif part[0] == "[":
                    attrs.append(re.match(r"\[([\w:-]+)(\*?=)?[\"']?([^\"'\]]*)", part).groups())
                else:
                    tag = part
            steps.append((tag, frozenset(classes), own, tuple(attrs)))
        chains.append(tuple(steps))
    return tuple(chains)


def _matches(node: Node, step: tuple) -> bool:
    tag, classes, own, attrs = step
    if tag is not None and node.tag != tag or own is not None and node.attrs.get("id") != own:
        return False
    if classes and not classes.issubset((node.attrs.get("class") or "").split()):
        return False
    for name, op, value in attrs:
        have = node.attrs.get(name)
        if have is None and name not in node.attrs or op and (have is None or (have != value if op == "=" else value not in have)):
            return False
    return True


def _ends(node: Node, chain: tuple) -> bool:
    if not _matches(node, chain[-1]):
        return False
    up, left = node.parent, len(chain) - 1
    while left and up is not None:
        if _matches(up, chain[left - 1]):
            left -= 1
        up = up.parent
    return not left


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _scan(pages: DataFrame, key: str, column: str, schema: str, rows_of, extra: tuple[str, ...] = ()) -> DataFrame:
    """One Arrow pass over pages: ``rows_of(tree, *extra values)`` gives the rows of a page.

    Pages come in small batches, and each tree, whose elements refer to each other, is
    taken apart after its page, so that a worker holds one tree at a time.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for values in zip(frame["key"], frame["html"], *[frame[c] for c in extra], strict=True):
                root = tree(values[1])
                out += [(values[0], *row) for row in rows_of(root, *values[2:])]
                root.free()
            yield pd.DataFrame(out, columns=["key", *names], dtype=object)
            del frame, out
            gc.collect()

    text_batches(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(column).alias("html"), *extra).mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def anchors(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``href`` and text of each link, in order."""
    return _scan(pages, key, column, "pos int, href string, title string", lambda t: [(i, a.attrs["href"], a.text()) for i, a in enumerate(t.select("a[href]")) if a.attrs["href"]])


def article_links(pages: DataFrame, least: int = 6, key: str = "page_id") -> DataFrame:
    """Links that look like articles of the page's site, the best of each URL first in score order."""
    rows = anchors(pages, key).join(pages.select(key, F.col("url").alias("source_url")), key)
    url = public_url(absolute(F.col("href"), F.col("source_url")))
    rows = rows.withColumn("url", url).where(F.col("url").isNotNull() & ~is_skipped_page(F.col("url")))
    rows = rows.withColumn("score", link_score(F.col("url"), F.col("title"), F.col("source_url"))).where(F.col("score") >= least)
    best = Window.partitionBy(key, "url").orderBy(F.col("score").desc(), "pos")
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1")
    return rows.select(key, "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "score")


def discovered_links(configured: DataFrame, heuristic: DataFrame, least: int = 3, most: int = 20, key: str = "page_id") -> DataFrame:
    """Configured links, and heuristic ones where a page has fewer than ``least``; first of a URL, ``most`` a page."""
    few = configured.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    rest = heuristic.join(few, key, "left_anti").select(key, "url", "title", F.lit(1).alias("kind"), F.col("score"))
    rows = configured.select(key, "url", "title", F.lit(0).alias("kind"), F.lit(0).alias("score")).unionByName(rest)
    first = Window.partitionBy(key, "url").orderBy("kind", F.col("score").desc())
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    place = Window.partitionBy(key).orderBy("kind", F.col("score").desc(), "url")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select(key, "url", "title", "place")


def thread_posts(pages: DataFrame, key: str = "thread", page: str = "page") -> DataFrame:
    """Posts of forum pages without quotes and media; ``order`` counts every post element of the page; a null page number stays null."""

    def rows(root: Node, number):
        number = None if number is None or number != number else int(number)  # a column with nulls comes as floats
        for order, post in enumerate(root.select("article.message--post")):
            author = post.select(".message-name .username, .message-name a")
            body = post.select(".message-body .bbWrapper")
            likes = post.select(".reactionsBar-link")
            if not body:
                continue
            body[0].remove(".bbCodeBlock--quote, .toggleTriggerAnchor, iframe, video, .bbMediaWrapper, script, style")
            text = body[0].text()
            count = re.search(r"\d+", likes[0].text()) if likes else None
            if len(text) > 10:
                yield (author[0].text() or "unknown" if author else "unknown", text[:1200], int(count[0]) if count else 0, order == 0 and number == 1, number, order)

    return _scan(pages, key, "html", "author string, body string, reactions int, is_op boolean, page int, order int", rows, (page,))


def thread_pages(pages: DataFrame, key: str = "thread") -> DataFrame:
    """Distinct pagination links of forum pages."""
    return _scan(pages, key, "html", "href string", lambda t: [(a.attrs.get("href"),) for a in t.select(".pageNav a[href]")]).distinct()


def listing_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of a listing page: title, link, author, date and self text."""

    def rows(root: Node):
        for i, thing in enumerate(root.select("div.thing")):
            title, author, time, text = (thing.select(s) for s in ("a.title", "a.author", "time", ".usertext-body"))
            if title:
                yield (i, title[0].text(), title[0].attrs.get("href"), author[0].text() if author else None, time[0].attrs.get("datetime") if time else None, text[0].text() if text else None)

    return _scan(pages, key, "html", "pos int, title string, href string, author string, published string, body string", rows)


def comment_rows(pages: DataFrame, key: str = "page_id", least: int = 20, most_depth: int = 3) -> DataFrame:
    """Comments of a comment page: depth by nesting, body and points of the comment's own entry, never of its replies.

    Deleted and removed ones, short ones and those below ``most_depth`` are dropped;
    ``order`` counts those that stay.
    """
    (comment,) = compiled('div.thing[data-type="comment"]')[0]
    (own,) = compiled(".entry")[0]

    def rows(root: Node):
        order = 0
        for node in root.select('div.thing[data-type="comment"]'):
            depth, up = 1, node.parent
            while up is not None:
                depth, up = depth + _matches(up, comment), up.parent
            author = node.attrs.get("data-author") or "unknown"
            entries = [c for c in node.children if isinstance(c, Node) and _matches(c, own)]
            bodies = [b for e in entries for b in e.select(".usertext-body .md")]
            text = bodies[0].text() if bodies else ""
            if depth > most_depth or author == "[deleted]" or text in ("[deleted]", "[removed]") or len(text) < least:
                continue
            points = next((p.attrs.get("title") for e in entries for p in e.select(".score.unvoted")), None)
            number = re.match(r"\s*[+-]?\d+", points or "")
            yield (order, depth, author, text[:900], int(number[0]) if number else 0)
            order += 1

    out = _scan(pages, key, "html", "order int, depth int, author string, body string, reactions int", rows)
    bonus = F.when(F.col("depth") == 1, 0.8).otherwise(0.2)
    return out.withColumn("score", comment_score(F.col("body"), F.col("reactions"), F.col("depth"), F.col("order") + 1) + bonus)


def repository_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Trending repositories as articles: name, description, language, stars and a text block of them."""

    def rows(root: Node):
        for i, row in enumerate(root.select("article.Box-row")):
            name, about, language = (row.select(s) for s in ("h2 a", "p", '[itemprop="programmingLanguage"]'))
            if name:
                stars = [a.text() for a in row.select("a[href]") if (a.attrs.get("href") or "").endswith("/stargazers")]
                today = re.search(r"([\d,]+) stars today", row.text())
                yield (i, "".join(name[0].text().split()), name[0].attrs.get("href"), about[0].text() if about else None, language[0].text() if language else None, stars[0] if stars else None, today[1] if today else None)

    out = _scan(pages, key, "html", "pos int, name string, href string, about string, language string, stars string, today string", rows)
    line = lambda label, c: F.concat(F.lit(label + ": "), F.col(c))
    return out.withColumn("raw_content", F.concat_ws("\n", "about", line("Language", "language"), line("Stars", "stars"), line("Today", "today")))


def page_metadata(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title (h1, og:title, title), image and date of a page; candidates are columns, the choice is a ``coalesce``."""

    def rows(root: Node):
        meta = {(n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or ""): n.attrs.get("content") for n in root.select("meta")}
        one = lambda s: next((n.text() for n in root.select(s)), None)
        times = [n.attrs.get("datetime") for n in root.select("time[datetime]")]
        yield (one("h1"), meta.get("og:title"), one("title"), meta.get("og:image"), *[meta.get(m) for m in ("article:published_time", "pubdate", "date", "datePublished")], times[0] if times else None)

    names = "h1 string, og_title string, title_tag string, image string, m1 string, m2 string, m3 string, m4 string, time string"
    out = _scan(pages, key, "html", names, rows)
    filled = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    return out.select(key, filled("h1", "og_title", "title_tag").alias("title"), filled("image").alias("image_url"), filled("time", "m1", "m2", "m3", "m4").alias("published"))


def _placed_body(root: Node, places: list[tuple[str, tuple]]) -> tuple[str, str | None]:
    """The longest text of the places and its place; the first wins ties, nothing found is an empty text."""
    first: dict[str, Node] = {}
    for node in root.walk():  # one walk for all places
        for selector, chains in places:
            if selector not in first and node is not root and any(_ends(node, c) for c in chains):
                first[selector] = node
    texts: dict[int, str] = {}
    best, place = "", None
    for selector, _ in places:
        if selector in first:
            node = first[selector]
            text = texts[id(node)] = texts.get(id(node)) or node.text()
            if len(text) > len(best):
                best, place = text, selector
    return best, place


def page_bodies(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The longest text of the known body places after the noise is removed; the first place wins ties."""

    places = [(selector, compiled(selector)) for selector in BODIES]

    def rows(root: Node):
        root.remove(NOISE)
        yield _placed_body(root, places)

    return _scan(pages, key, "html", "body string, extractor string", rows)


#: Elements whose text belongs to the block around them.
INLINE = frozenset("#root a abbr b bdi bdo br cite code del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Characters that a block must have beyond twice its linked ones to count for its element, and not against it.
BLOCK_COST = 20


def densest(root: Node) -> Node | None:
    """The element whose blocks hold the most text that is no link, or None where no block counts for one.

    The text of a block is that in it which no block inside it holds, white space
    squeezed string by string.  A block of n characters, m of them in links, is worth
    n - 2 m - ``BLOCK_COST``, so short and linked blocks count against the elements
    around them; one without text is worth nothing.  An element is worth the sum of
    the blocks from it downwards, all summed in one pass from the leaves up.  The
    deepest element of the greatest worth is taken, the first in the page of several.
    """
    order = list(root.walk())  # parents before their children
    block, linked = {id(root): root}, {id(root): False}
    sizes: dict[int, list[int]] = {}
    for node in order:
        if node is not root:
            block[id(node)] = block[id(node.parent)] if node.tag in INLINE else node
            linked[id(node)] = node.tag == "a" or linked[id(node.parent)]
        size = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if size:
            own = sizes.setdefault(id(block[id(node)]), [0, 0])
            own[0] += size
            own[1] += size if linked[id(node)] else 0
    worth: dict[int, int] = {}
    best, most = None, 0
    for node in reversed(order):  # children before their parents, later ones first
        size, links = sizes.get(id(node), (0, 0))
        own = worth[id(node)] = worth.get(id(node), 0) + (size - 2 * links - BLOCK_COST if size else 0)
        if node.parent is not None:
            worth[id(node.parent)] = worth.get(id(node.parent), 0) + own
        if node.tag not in INLINE and (own > most or (own == most and best is not None and not _above(node, best))):
            best, most = node, own
    return best


def _above(node: Node, other: Node) -> bool:
    while other is not None and other is not node:
        other = other.parent
    return other is node


def dense_bodies(pages: DataFrame, least: int = 500, key: str = "page_id") -> DataFrame:
    """``body, extractor``: the text of the known places if it has ``least`` characters, else the longer of it and the ``densest`` element's.

    The noise is removed before; a page without text has an empty body and no
    extractor, a null page too.  Pages may be nested as deep as they like.
    """
    places = [(selector, compiled(selector)) for selector in BODIES]

    def rows(root: Node):
        root.remove(NOISE)
        text, place = _placed_body(root, places)
        if len(text) < least and (node := densest(root)) is not None and len(dense := node.text()) > len(text):
            text, place = dense, "density"
        yield (text, place)

    return _scan(pages, key, "html", "body string, extractor string", rows)


def profile_bodies(pages: DataFrame, profiles: DataFrame, key: str = "page_id") -> DataFrame:
    """The longest text of a site profile's selectors after its removals; ``profiles(domain, content_selectors, remove_selectors)``."""
    from corpusflow.functions.url import host

    joined = pages.withColumn("domain", host(F.col("url"))).join(profiles, "domain")

    def rows(root: Node, content, remove):
        for selector in remove if remove is not None else []:
            root.remove(selector)
        texts = [n.text() for selector in (content if content is not None else []) for n in root.select(selector)[:1]]
        yield (max(texts, key=len, default=""),)

    return _scan(joined, key, "html", "body string", rows, ("content_selectors", "remove_selectors"))


def site_facts(html: Column, url: Column) -> dict[str, Column]:
    """Language, title, description, image, canonical URL and feed links of a page, as expressions."""
    attr = lambda tag, name: F.nullif(F.trim(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"'](.*?)[\"']", 1)), F.lit(""))
    tag = lambda pattern: F.regexp_extract(html, rf"(?i){pattern}", 0)
    links = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0))
    canonical = F.try_element_at(F.filter(links, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"'][^\"']*canonical")), F.lit(1))
    feeds = F.filter(links, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"'][^\"']*alternate") & t.rlike(r"(?i)application/(rss|atom)\+xml"))
    title = F.nullif(squeeze(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")), F.lit(""))
    return {
        "lang": attr(tag(r"<html\b[^>]*>"), "lang"), "title": F.coalesce(attr(tag(r"<meta\b[^>]*property=['\"]og:site_name['\"][^>]*>"), "content"), attr(tag(r"<meta\b[^>]*property=['\"]og:title['\"][^>]*>"), "content"), title),
        "description": attr(tag(r"<meta\b[^>]*(?:name|property)=['\"](?:description|og:description)['\"][^>]*>"), "content"), "image": attr(tag(r"<meta\b[^>]*property=['\"]og:image['\"][^>]*>"), "content"),
        "canonical": F.coalesce(absolute(attr(canonical, "href"), url), url), "feeds": F.array_distinct(F.transform(feeds, lambda t: absolute(attr(t, "href"), url))),
        "is_feed": F.substring(html, 1, 3000).rlike(r"(?i)<(rss|feed)[\s>]"),
    }


# Marks of UTF-8 that was read as Latin-1, and control characters that are dropped.
MOJIBAKE = re.compile("[\u00c3\u00c2\u00e2][\u0080-\u00bf]")
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
TEXT_FIELDS = ("title", "raw_excerpt", "raw_content", "summary_text", "summary_short", "tldr")


def repair_text(values: pd.Series) -> pd.Series:
    """UTF-8 that was read as Latin-1 put right where that lowers the number of its marks, then entities decoded; null stays null."""

    def one(v: str) -> str:
        marks = len(MOJIBAKE.findall(v))
        if marks:
            low = v.encode("utf-16-le", "surrogatepass")[::2]  # the low byte of every code unit
            fixed = low.decode("utf-8", "replace")
            v = fixed if len(MOJIBAKE.findall(fixed)) < marks else v
        return entities.unescape(v)

    return values.map(one, na_action="ignore")


def with_repaired(rows: DataFrame, columns: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """The text columns repaired, entities decoded and control characters dropped."""
    fix = F.pandas_udf(repair_text, "string")
    return rows.withColumns({c: F.regexp_replace(fix(c), CONTROLS, "") for c in columns})
