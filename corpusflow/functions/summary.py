"""Expressions over generated summaries: parsing, validation and repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import let, strip_markup, tldr_from_summary, trimmed

# Converted amounts and time zones whose repetition marks a bad summary.
AMOUNT = (
    r"(?iu)((?:[$€£¥]\s*)?\d[\d.,]*(?:\s*(?:nghìn|triệu|tỷ|thousand|million|billion))?"
    r"(?:\s*(?:nhân\s+dân\s+tệ|ndt|cny|yuan|renminbi|usd|eur|gbp|jpy|đô\s+la|euro|yên))?)"
    r"\s*\([^)]*(?:khoảng|tương\s+đương)[^)]*(?:vnđ|vnd|đồng)[^)]*\)"
)
ZONE = r"(?iu)giờ\s+Việt\s+Nam"
ZONE_NOTE = r"(?iu)\([^)]*(?:tức|khoảng)[^)]*giờ\s+Việt\s+Nam[^)]*\)"
# The names of an output's article.
ARTICLE_KEYS = ("editorial_markdown", "editorialMarkdown", "editorialmarkdown")


def _text(*cols: Column) -> Column:
    out = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
    return F.coalesce(out, F.lit(""))


def enough_text(markdown: Column) -> Column:
    return F.length(F.regexp_replace(markdown, r"[#*_`\s-]", "")) >= 120


def parse_output(raw: Column, allowed_tags: list[str]) -> Column:
    """A summary's fields from JSON (fenced, bare or embedded), else from the legacy ``<tldr>`` form.

    The first object that names an article counts.  If its article is blank, the
    score and the tags stay, the tldr becomes empty, and it is not usable; it is
    not read as a legacy form, which would take the JSON itself for the article.
    """
    canon = F.create_map(*[F.lit(x) for t in allowed_tags for x in (t.lower(), t)])
    none = F.array().cast("array<string>")
    is_json = lambda t: t.startswith("{") & F.try_parse_json(F.nullif(t, F.lit(""))).isNotNull()

    def candidates(r: Column) -> Column:
        text = F.trim(r)
        forms = F.array(F.trim(F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)), text, F.regexp_extract(text, r"(?s)(\{.*\})", 1))
        objects = F.transform(F.filter(F.array_distinct(forms), is_json), lambda t: F.from_json(t, "map<string,string>"))
        return F.try_element_at(F.filter(objects, lambda m: F.exists(F.map_keys(m), lambda k: k.isin(*ARTICLE_KEYS))), F.lit(1))

    def fields(v: Column) -> Column:
        parsed, r = v["parsed"], v["raw"]
        score = F.coalesce(parsed["hot_score"], parsed["hotScore"]).try_cast("double")
        score = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(score + F.lit(0.5)))).cast("int")
        tags = F.transform(F.coalesce(F.from_json(parsed["tags"], "array<string>"), none), lambda t: F.try_element_at(canon, F.lower(F.trim(t))))
        articles = [trimmed(parsed[k]) for k in ARTICLE_KEYS]
        body = F.coalesce(*[F.nullif(a, F.lit("")) for a in articles], *articles)
        return F.struct(
            r.alias("raw"), parsed.isNotNull().alias("ok"), body.alias("body"), score.alias("score"),
            F.slice(F.array_distinct(F.filter(tags, lambda t: t.isNotNull())), 1, 3).alias("tags"), _text(parsed["tldr"]).alias("tldr"),
            F.nullif(_text(parsed["summary_short"], parsed["summaryShort"]), F.lit("")).alias("short"),
            F.nullif(_text(parsed["translated_title"], parsed["translatedTitle"]), F.lit("")).alias("title"),
        )

    def choose(v: Column) -> Column:
        ok = v["ok"]
        tldr = F.when(ok, F.when(v["body"] == "", "").otherwise(v["tldr"])).otherwise(F.trim(F.regexp_extract(v["raw"], r"(?is)<tldr>(.*?)</tldr>", 1)))
        markdown = F.when(ok, v["body"]).otherwise(trimmed(F.regexp_replace(v["raw"], r"(?is)\A(.*?)<tldr>.*?</tldr>", "$1")))
        return F.struct(
            tldr.alias("tldr"), F.when(ok, v["short"]).alias("summary_short"), F.when(ok, v["score"]).alias("hot_score"), F.when(ok, v["tags"]).otherwise(none).alias("tags"),
            markdown.alias("editorial_markdown"), ok.alias("structured"), ((tldr != "") & enough_text(markdown)).alias("usable"), F.when(ok, v["title"]).alias("translated_title"),
        )

    return let(raw, lambda r: let(let(F.struct(r.alias("raw"), candidates(r).alias("parsed")), fields), choose))


def _amount_key(c: Column) -> Column:
    """One spelling of an amount; ``AMOUNT`` matches composed letters only, so its matches are in normal form already."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"[.,](?=\d{3}\b)", ""))


def is_repetitive(text: Column) -> Column:
    """A block with three time-zone conversions, or with one converted amount three times."""
    blocks = F.split(text, r"\n{2,}")

    def bad(block: Column) -> Column:
        zones = (F.regexp_count(block, F.lit(ZONE)) >= 3) & (F.regexp_count(block, F.lit(ZONE_NOTE)) >= 3)
        keys = F.filter(F.transform(F.regexp_extract_all(block, F.lit(AMOUNT), F.lit(1)), _amount_key), lambda k: k != "")
        return zones | F.exists(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) >= 3)

    return F.exists(blocks, bad)


def is_usable(parsed: Column) -> Column:
    combined = F.concat_ws("\n\n", parsed["tldr"], F.coalesce(parsed["summary_short"], F.lit("")), parsed["editorial_markdown"])
    return parsed["usable"] & ~is_repetitive(combined)


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*```(?:json|markdown)?\s*", ""), r"\s*```\s*$", ""))


def long_tldr_fix(tldr: Column, summary: Column, most: int = 180) -> Column:
    """A shorter tldr where the stored one is longer than ``most``; null where nothing changes."""
    fixed = tldr_from_summary(F.when(strip_markup(summary) != "", summary).otherwise(tldr), most)
    return F.when((F.length(tldr) > most) & (fixed != tldr), fixed)
