"""Feeds, search, tags, days, clusters and digests as plans over articles and sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.dates import local_date, local_date_text
from corpusflow.functions.text import tag_key
from corpusflow.operators.search import narrowed
from corpusflow.schemas import SUMMARY_STATUSES

TABS = ("all", "news", "tech", "voz", "reddit", "saved")
SORTS = ("latest", "hot")
ISSUES = ("missing_tldr", "missing_summary_short", "missing_tags", "missing_hot_score", "short_summary")


def when_published() -> Column:
    return F.coalesce("published_at", "created_at")


def is_fresh(as_of: Column) -> Column:
    return when_published() <= as_of + F.expr("INTERVAL 2 HOURS")


def _is_reddit() -> Column:
    return F.col("source_name").ilike("%reddit%") | F.col("url").ilike("%reddit.com%") | F.col("title").ilike("[r/%")


def _is_voz() -> Column:
    return F.col("source_name").ilike("%voz%") | F.col("url").ilike("%voz.vn%")


def in_tab(tab: str) -> Column:
    """Rows of a feed tab; a null source name makes a negated test null, which drops the row."""
    other = ~(_is_reddit() | _is_voz())
    kind = F.coalesce("feed_category", F.lit("news"))
    return {
        "all": other, "news": other & (kind == "news"), "tech": other & (kind == "tech"), "voz": _is_voz(), "reddit": _is_reddit(), "saved": F.col("is_saved"),
    }[tab]


def has_issue(issue: str) -> Column:
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    test = {
        "missing_tldr": blank("tldr"), "missing_summary_short": blank("summary_short"), "missing_tags": F.col("tags").isNull() | (F.size("tags") == 0),
        "missing_hot_score": F.col("hot_score").isNull(), "short_summary": F.length(F.trim(F.coalesce("summary_text", F.lit("")))) < 200,
    }
    return (F.col("summary_status") == "done") & test[issue]


def issues() -> Column:
    """All quality issues of a finished article, as an array."""
    return F.array_compact(F.array(*[F.when(has_issue(i), i) for i in ISSUES]))


@dataclass(frozen=True)
class FeedQuery:
    """Arguments of a feed; wrong ones raise ``ValueError``, page and limit are clamped."""

    tab: str | None = None
    sort: str = "latest"
    source_id: str | None = None
    status: str | None = None
    date: str | None = None
    tag: str | None = None
    min_score: int | None = None
    issue: str | None = None
    include_followers: bool = False
    include_future: bool = False
    page: int = 1
    limit: int = 20

    def __post_init__(self):
        for name, value, known in (("tab", self.tab, TABS), ("sort", self.sort, SORTS), ("status", self.status, SUMMARY_STATUSES), ("issue", self.issue, ISSUES)):
            if value is not None and value not in known:
                raise ValueError(f"Invalid {name}")
        if self.min_score is not None and not 1 <= self.min_score <= 10:
            raise ValueError("min_score must be between 1 and 10")
        if self.date is not None and len(self.date.split("-")) != 3:
            raise ValueError("date must be YYYY-MM-DD")
        object.__setattr__(self, "page", min(500, max(1, self.page)))
        object.__setattr__(self, "limit", min(100, max(1, self.limit)))


def with_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles with their source's name and category, unknown sources kept."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "feed_category")
    return articles.join(names, "source_id", "left")


def matching(articles: DataFrame, sources: DataFrame, q: FeedQuery, as_of: Column) -> DataFrame:
    """Articles that a feed query selects, before order and page."""
    out = with_sources(articles, sources)
    saved = q.tab == "saved"
    if not (q.include_future or saved):
        out = out.where(is_fresh(as_of))
    if q.source_id:
        out = out.where(F.col("source_id") == q.source_id)
    if q.status:
        out = out.where(F.col("summary_status") == q.status)
    if q.date and not saved:
        out = out.where(local_date(when_published()) == F.lit(q.date).cast("date"))
    if q.tag:
        out = out.where(F.array_contains("tags", q.tag.strip()))
    if q.min_score:
        out = out.where(F.col("hot_score") >= q.min_score)
    if q.tab:
        out = out.where(in_tab(q.tab))
    if q.issue:
        out = out.where(has_issue(q.issue))
    if not (q.include_followers or q.status or q.issue):
        out = out.where("parent_article_id is null")
    return out


def feed_order(sort: str) -> list[Column]:
    """``hot`` is score then time, ``latest`` is time; the id settles ties."""
    latest = [when_published().desc_nulls_last(), F.col("id").desc()]
    return [F.coalesce("hot_score", F.lit(0)).desc(), *latest] if sort == "hot" else latest


def follower_counts(articles: DataFrame) -> DataFrame:
    return articles.where("parent_article_id is not null").groupBy(F.col("parent_article_id").alias("id")).agg(F.count(F.lit(1)).alias("follower_count"))


def feed(articles: DataFrame, sources: DataFrame, q: FeedQuery, as_of: Column) -> DataFrame:
    """One page of a feed: the page is cut first, followers are counted for its rows only."""
    page = matching(articles, sources, q, as_of).orderBy(*feed_order(q.sort)).offset((q.page - 1) * q.limit).limit(q.limit)
    counts = follower_counts(articles.join(page.select(F.col("id").alias("parent_article_id")), "parent_article_id", "left_semi"))
    return page.join(counts, "id", "left").select(
        "id", "title", "url", "source_id", "source_name", "summary_status", F.coalesce("hot_score", F.lit(0)).alias("hot_score"),
        F.date_format(when_published(), "yyyy-MM-dd HH:mm:ss").alias("feed_time"), F.coalesce("follower_count", F.lit(0)).cast("long").alias("follower_count"),
    )


def page_count(articles: DataFrame, sources: DataFrame, q: FeedQuery, as_of: Column) -> DataFrame:
    total = matching(articles, sources, q, as_of).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.ceil(F.col("total") / q.limit).cast("long").alias("pages"))


def search(articles: DataFrame, sources: DataFrame, text: str, as_of: Column, tab: str | None = None, limit: int = 20, index: str | None = None) -> DataFrame:
    """Finished articles whose title, short summary or tldr holds the text; title hits count double.

    With the path of an ``index`` of these three columns only articles that it does not rule out are looked at.
    """
    if len(text.strip()) < 2:
        raise ValueError("query must have at least 2 characters")
    like = f"%{text.strip()}%"
    if index:
        articles = narrowed(articles, index, like)
    title, short, tldr = (F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in ("title", "summary_short", "tldr"))
    relevance = F.when(title, 2).otherwise(0) + F.when(short | tldr, 1).otherwise(0)
    rows = with_sources(articles, sources).where((F.col("summary_status") == "done") & is_fresh(as_of) & (title | short | tldr))
    if tab:
        rows = rows.where(in_tab(tab))
    rows = rows.withColumn("relevance", relevance)
    top = rows.orderBy(F.col("relevance").desc(), when_published().desc_nulls_last(), F.col("id").desc()).limit(min(50, max(1, limit)))
    return top.select("id", "title", "source_name", "relevance", F.date_format(when_published(), "yyyy-MM-dd HH:mm:ss").alias("feed_time"))


def tag_counts(articles: DataFrame, sources: DataFrame, as_of: Column, tab: str = "all", limit: int = 20) -> DataFrame:
    rows = with_sources(articles, sources).where((F.col("summary_status") == "done") & is_fresh(as_of) & in_tab(tab))
    tags = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.orderBy(F.col("n").desc(), "tag").limit(limit)


def day_counts(articles: DataFrame, as_of: Column, limit: int = 60) -> DataFrame:
    rows = articles.where(is_fresh(as_of) & F.col("parent_article_id").isNull())
    days = rows.groupBy(local_date_text(when_published()).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.orderBy(F.col("date").desc()).limit(limit)


def day_steps(articles: DataFrame, as_of: Column) -> DataFrame:
    """Each listed day with the next older and the next newer one; the list has at most 60 days."""
    w = Window.orderBy(F.col("date").desc())
    return day_counts(articles, as_of).select("date", F.lead("date").over(w).alias("older"), F.lag("date").over(w).alias("newer"))


def cluster_view(articles: DataFrame) -> DataFrame:
    """Each article with its cluster: ``id, leader_id, members``, members counting the leader where it is there; one row an article."""
    rows = articles.select("id", F.coalesce("parent_article_id", "id").alias("leader_id"))
    sizes = rows.groupBy("leader_id").agg(F.count(F.lit(1)).alias("members"))
    return rows.join(sizes, "leader_id").select("id", "leader_id", "members")


def siblings(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, sibling``: the other members of the cluster of each of the asked ``ids``."""
    rows = articles.select("id", F.coalesce("parent_article_id", "id").alias("leader"))
    asked = rows.join(ids.select("id").distinct(), "id", "left_semi")
    members = rows.select(F.col("id").alias("sibling"), "leader")
    return asked.join(members, "leader").where("id <> sibling").select("id", "sibling")


def personal(articles: DataFrame, muted: list[str], bookmarks: DataFrame | None = None) -> DataFrame:
    """Articles without a muted tag, of the bookmarked ones if bookmarks are given."""
    keys = F.transform(F.coalesce("tags", F.array().cast("array<string>")), tag_key)
    rows = articles.where(~F.arrays_overlap(keys, F.array(*[F.lit(m.strip().lower()) for m in muted]).cast("array<string>")))
    return rows if bookmarks is None else rows.join(bookmarks.select("id").distinct(), "id", "left_semi")


def is_new(as_of: Column) -> Column:
    age = F.unix_timestamp(as_of) - F.unix_timestamp(when_published())
    return age.between(0, 6 * 3600)


def digest_candidates(articles: DataFrame, sources: DataFrame, as_of: Column, most: int = 500) -> DataFrame:
    """Finished articles of the last 24 hours, hottest first, with their number and text line."""
    rows = with_sources(articles, sources).where((F.col("summary_status") == "done") & (when_published() > as_of - F.expr("INTERVAL 24 HOURS")) & (when_published() <= as_of))
    order = [F.col("hot_score").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("id")]
    top = rows.orderBy(*order).limit(most)
    number = F.row_number().over(Window.orderBy(*order))  # at most ``most`` rows
    line = F.concat(F.col("position").cast("string"), F.lit(". ["), F.coalesce("source_name", F.lit("?")), F.lit("] "), F.col("title"))
    return top.withColumn("position", number).select("position", F.col("id").alias("article_id"), "source_name", "title", line.alias("line"))


def digest(candidates: DataFrame) -> DataFrame:
    """One row: the number of articles and the text lines in order (a digest has at most 500)."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n")
    return candidates.agg(F.count(F.lit(1)).alias("article_count"), lines.alias("body"))


def digest_by_source(candidates: DataFrame) -> DataFrame:
    label = F.coalesce("source_name", F.lit("?"))
    return candidates.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label")


def short_digest(candidates: DataFrame, intro: str, most: int = 5) -> DataFrame:
    top = candidates.where(F.col("position") <= most)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "title"))), lambda s: F.concat(F.lit("- "), s["title"])), "\n")
    return top.agg(F.concat(F.lit(intro + "\n"), lines).alias("body"))
