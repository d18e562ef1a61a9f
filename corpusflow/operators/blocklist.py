"""Matching URLs against block-list rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import let
from corpusflow.functions.url import host

#: Lengths of anchors: a rule is found by the longest of these that its literal part holds.
ANCHORS = (16, 12, 8, 6, 4, 3, 2, 1)
#: Rules up to this number are broadcast, more are joined by a shuffle.
FEW_RULES = 200_000


def host_suffixes(url: Column) -> Column:
    """A host and all the domains above it."""
    labels = F.split(host(url), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def wildcard(pattern: Column) -> Column:
    """A path rule with ``*`` as a regular expression anchored at the start."""
    escaped = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit("[^?#]*")))


def _anchored(rules: DataFrame) -> DataFrame:
    """Path rules with the ``anchor`` they are found by, its ``width``, and ``wild``, whether it may stand anywhere.

    The anchor of a rule with ``*`` is the start of its longest piece between stars,
    that of another rule its own start; rules of stars only have an empty one.
    """
    pieces = F.split("pattern", r"\*")
    longest = F.reduce(pieces, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    out = rules.select("id", "pattern", F.contains("pattern", F.lit("*")).alias("wild"), longest.alias("piece"))
    fits = [F.when(F.length("piece") >= w, w) for w in ANCHORS]
    out = out.withColumn("width", F.coalesce(*fits, F.lit(0)))
    return out.withColumn("anchor", F.col("piece").substr(F.lit(1), F.col("width"))).drop("piece")


def _windows(text: Column, widths: list[int]) -> Column:
    """Every distinct stretch of ``text`` of one of the widths; the text is cut into characters once."""

    def of_width(chars: Column, w: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(chars) - w + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(w)), ""))
        return F.when(F.size(chars) >= w, cut).otherwise(F.array().cast("array<string>"))

    return let(F.split(text, ""), lambda chars: F.array_distinct(F.concat(*[of_width(chars, w) for w in widths])))


def match(urls: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """Each distinct URL that a rule hits, with the first rule: domains before paths, then by pattern.

    Domain rules meet the exploded host suffixes in an equi-join.  A path rule begins
    at a segment of the URL, a rule with ``*`` at its front only, up to ``?`` or ``#``
    for each star.  Every path rule has an anchor, a literal of up to 16 characters:
    plain rules meet the URL's segment starts by it, rules with ``*`` the stretches of
    the same length of the URL, and then both are compared in full.  Widths differ by
    rule, so a short rule makes no other one short; only the widths that rules have
    are cut.  No rule meets all URLs but one of stars only, of which the first
    pattern counts.  Null URLs, null and empty patterns hit nothing.  URLs are dealt to
    a fixed number of tasks, since cutting them costs far more than the bytes that
    adaptive execution counts, and what is cut from them meets few rules in a broadcast,
    so that it is neither shuffled nor sorted.
    """
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = urls.select(F.col(key).alias("url")).where("url is not null").distinct().repartition(tasks)
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    small = F.broadcast if few else lambda df: df
    domains = small(rules.where("type = 'domain'").select(F.col("pattern").alias("suffix"), "id", "pattern"))
    by_host = base.select("url", F.explode(F.array_distinct(host_suffixes(F.col("url")))).alias("suffix")).join(domains, "suffix").select("url", F.lit(0).alias("kind"), "pattern", "id")
    paths = _anchored(rules.where("type = 'path' and pattern <> ''"))
    found = [tuple(r) for r in paths.select("wild", "width").distinct().collect()]  # at most two for each width
    plain, starred = (sorted(w for is_wild, w in found if is_wild == kind and w) for kind in (False, True))
    bare = base.select("url", F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", "").alias("bare"))
    hits = [by_host]
    if plain:
        parts = F.split("bare", "/")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        at = bare.select("url", F.explode(F.array_distinct(suffixes)).alias("rest"))
        starts = F.explode(F.array_distinct(F.array(*[F.left("rest", F.lit(w)) for w in plain])))
        by_path = at.select("url", "rest", starts.alias("anchor")).join(small(paths.where("not wild")), "anchor").where(F.col("rest").startswith(F.col("pattern")))
        hits.append(by_path.select("url", F.lit(1).alias("kind"), "pattern", "id"))
    if starred:
        at = bare.select("url", "bare", F.explode(_windows(F.col("bare"), starred)).alias("anchor"))
        by_piece = at.join(small(paths.where("wild and width > 0")), "anchor").where(F.regexp_like("bare", wildcard(F.col("pattern"))))
        hits.append(by_piece.select("url", F.lit(1).alias("kind"), "pattern", "id"))
    if (True, 0) in found:
        first = paths.where("width = 0").agg(F.min(F.struct("pattern", "id"))).first()[0]
        hits.append(base.select("url", F.lit(1).alias("kind"), F.lit(first["pattern"]).alias("pattern"), F.lit(first["id"]).alias("id")))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    first = every.groupBy("url").agg(F.min(F.struct("kind", "pattern", "id")).alias("m"))
    return first.select("url", "m.id", "m.pattern")


def hits(urls: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """``id, hits``: the rows whose URL each rule is the first to hit; rules without any are left out.

    Rows are counted by URL where they are read, so that the join meets each distinct
    URL once, however often it comes, in a fixed number of tasks: bytes shrink too well
    in a shuffle for adaptive execution to tell how many rows a task would hold.
    """
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = urls.select(F.col(key).alias("url")).where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    matched = match(urls, rules, key).select("url", "id")
    return counts.repartition(tasks, "url").join(matched.repartition(tasks, "url"), "url").groupBy("id").agg(F.sum("n").alias("hits"))
