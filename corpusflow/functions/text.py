"""Text expressions: hashing, normalising, token sets, previews and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{00A0}]+"
PUNCT = r"[\p{P}\p{S}]"
# How many of each thing count.
MIN_WORDS_FOR_WORD_SETS = 4
TOP_KEYWORDS = 30
SIGNATURE_KEYWORDS = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it; keeps nested expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """White space (no-break space too) squeezed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WS, " "))


def trimmed(c: Column) -> Column:
    """Without spaces of any kind (Unicode ``Zs``) at both ends, as SQL's ``trim`` has it."""
    return F.regexp_replace(c, r"\A\p{Zs}+|\p{Zs}+\z", "")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(c)).cast("binary"), 256), 1, 32)


def similarity_text(c: Column) -> Column:
    """Lower case, tags and punctuation to spaces, squeezed."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, PUNCT, " "), WS, " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def word_set(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: F.length(t) >= 2))


def bigram_set(norm: Column) -> Column:
    """Character bigrams inside each token; a one-letter token stands for itself."""
    grams = F.flatten(
        F.transform(
            tokens(norm),
            lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))),
        )
    )
    return F.when(F.length(norm) >= 2, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def top_keywords(norm: Column, n: int = TOP_KEYWORDS) -> Column:
    """The ``n`` most frequent tokens of three letters or more; ties by first place.

    The tokens are made and sorted once; a word's count is the length of its run.
    """
    words = F.filter(F.split(norm, " "), lambda t: F.length(t) >= 3)
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def runs(s: Column) -> Column:
        first = lambda x, i: (i == 0) | (F.get(s, i - 1)["word"] != x["word"])
        return F.filter(F.transform(s, lambda x, i: F.when(first(x, i), F.struct(i.alias("from"), x["word"].alias("word"), x["at"].alias("at")))), lambda x: x.isNotNull())

    def counted(s: Column) -> Column:
        ends = lambda r, i: F.coalesce(F.get(r, i + 1)["from"], F.size(s))
        return let(runs(s), lambda r: F.transform(r, lambda x, i: F.struct((x["from"] - ends(r, i)).alias("n"), x["at"].alias("at"), x["word"].alias("word"))))

    return F.transform(F.slice(F.array_sort(let(placed, counted)), 1, n), lambda s: s["word"])


def novelty(candidate_keywords: Column, leader_keywords: Column) -> Column:
    """Share of the candidate's keywords that the leader lacks; 0 without keywords."""
    n = F.size(candidate_keywords)
    return F.when(n > 0, F.size(F.array_except(candidate_keywords, leader_keywords)) / n).otherwise(F.lit(0.0))


def cluster_signature(title: Column, excerpt: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(excerpt, F.lit("")))
    return F.array_join(top_keywords(similarity_text(text), SIGNATURE_KEYWORDS), "|")


def html_to_text(c: Column) -> Column:
    """Script and style dropped, tags to spaces, the basic entities decoded, squeezed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    # The entities that are decoded.
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def snippet_fallback(content: Column, excerpt: Column, least: int) -> Column:
    """What stands in for an article that could not be fetched: the content, else the excerpt, that squeezed has ``least`` characters; else null."""
    enough = lambda c: F.length(squeeze(c)) >= least
    return F.when(enough(content), content).when(enough(excerpt), excerpt)


def longest_text(full: Column, content: Column, excerpt: Column, least: int) -> Column:
    """The fetched text if it is longer than the content, else the content.

    Where nothing was fetched (``full`` is null), the ``snippet_fallback`` comes
    before the content.
    """
    own = F.coalesce(content, F.lit(""))
    return F.when(F.length(full) > F.length(own), full).when(full.isNull(), F.coalesce(snippet_fallback(content, excerpt, least), own)).otherwise(own)


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def strip_markup(c: Column) -> Column:
    """Markdown and tags removed from a short summary."""
    steps = (
        (r"<[^>]+>", " "), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^#+\s+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[*_`>#]", ""),
    )
    out = F.coalesce(c, F.lit(""))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return squeeze(out)


def normalize_tldr(c: Column, most: int = 200) -> Column:
    """At most ``most`` characters: a first sentence of 70 to ``most``, else a cut at the last space after 80, with dots."""
    clean = strip_markup(c)
    low = min(70, max(40, most - 80))
    sentence = F.trim(F.regexp_extract(clean, rf"^(.{{{low},{most}}}?[.!?])\s", 1))
    cut = F.substring(clean, 1, most - 3)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")  # index of the last space from 0; the length if there is none
    shorter = F.when((F.instr(cut, " ") > 0) & (space > 80), cut.substr(F.lit(1), space)).otherwise(cut)
    return F.when(F.length(clean) <= most, clean).when(sentence != "", sentence).otherwise(F.concat(F.trim(shorter), F.lit("...")))


def tldr_from_summary(c: Column, most: int = 200) -> Column:
    clean = strip_markup(c)
    first = F.regexp_extract(clean, r"^(.{40,180}?[.!?])\s", 1)
    return normalize_tldr(F.when(first != "", first).otherwise(clean), most)


def preview(tldr: Column, excerpt: Column, summary: Column, content: Column) -> Column:
    """The first text of 30 characters or more, at most 180 long unless it is the tldr."""
    blank = lambda c: squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))
    short = lambda c: F.when(F.length(blank(c)) >= 30, F.substring(blank(c), 1, 180))
    return F.coalesce(F.when(F.length(blank(tldr)) >= 30, blank(tldr)), short(excerpt), short(summary), short(content))


def reading_minutes(c: Column) -> Column:
    words = F.size(F.filter(F.split(squeeze(c), " "), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words / 200 + F.lit(0.5))).cast("int")


def source_label(title: Column, name: Column) -> Column:
    sub = F.regexp_extract(title, r"^\[r/([^\]]+)\]", 1)
    return F.when(sub != "", F.concat(F.lit("r/"), sub)).otherwise(F.upper(F.coalesce(name, F.lit(""))))


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"^\[r/[^\]]+\]\s*", ""))


def tag_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def visible_tags(tags: Column, most: int = 2) -> Column:
    """The first ``most`` tags without blanks or repeats."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")), 1, most)


def clean_list(values: Column, default: list[str]) -> Column:
    """Trimmed, without blanks, unique regardless of case with the first spelling kept; ``default`` if nothing is left."""
    kept = F.filter(F.transform(values, lambda t: F.trim(t)), lambda t: t != "")
    keys = F.transform(kept, lambda t: F.lower(t))
    first = F.filter(kept, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)
    return F.when(F.size(first) > 0, first).otherwise(F.array(*[F.lit(d) for d in default]))


def bullets(c: Column, most: int = 2) -> Column:
    """The first bullet lines joined by a middle dot."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("- ") | x.startswith("* "))
    return F.array_join(F.slice(F.transform(lines, lambda x: F.trim(x.substr(F.lit(3), F.length(x)))), 1, most), " · ")
