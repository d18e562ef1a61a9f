"""URL rules spread to aliases over redirect and canonical-link edges, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.url import resolved
from corpusflow.operators.components import connected_components
from corpusflow.runtime import materialize

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Comments, scripts and style sheets, in which tags do not count.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_TAG = r"""(?is)<(?:link|meta|base)[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: An attribute with its value in double, in single or without quotes; matched from left to right, so that no value is taken for a name.
ATTRIBUTE = r"""(?is)([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
REFRESH = r"""(?is)^\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?["']?\s*([^"'\s]+)"""
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null; ``rules`` is a literal list.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of two equal rules with different verdicts, ``allow`` wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made).otherwise(out)
    return out


def page_of(url: Column) -> Column:
    """The name of a page among its aliases: no fragment, scheme and host in lower case."""
    front = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.translate(front, UPPER, LOWER), F.substr(url, F.length(front) + 1)), r"(?s)#.*$", "")


def _character(reference: Column) -> Column:
    """What a character reference stands for; U+FFFD where there is no such character."""
    digits = F.regexp_extract(reference, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    point = F.conv(digits, 10, 10).cast("int")
    point = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.conv(digits, 16, 10).cast("int")).otherwise(point)
    fits = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    out = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, point).otherwise(0xFFFD).cast("long")), 8, "0")), "UTF-32")
    for name, char in NAMED.items():
        out = F.when(reference == name, char).otherwise(out)
    return out


def plain(value: Column) -> Column:
    """An attribute's value with its character references decoded once."""
    found = F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0))
    pieces = F.transform(F.split(value, REFERENCE, -1), lambda p, i: F.concat(p, F.coalesce(_character(F.get(found, i)), F.lit(""))))
    return F.when(F.instr(value, "&") > 0, F.array_join(pieces, "")).otherwise(value)


def _attributes(tag: Column) -> Column:
    """``array<struct<name, value>>`` of a tag, names in lower case."""
    found = F.regexp_extract_all(F.regexp_replace(tag, r"^<\w+", ""), F.lit(ATTRIBUTE), F.lit(0))
    value = lambda m: F.concat(*[F.regexp_extract(m, ATTRIBUTE, g) for g in (2, 3, 4)])
    return F.transform(found, lambda m: F.struct(F.lower(F.regexp_extract(m, ATTRIBUTE, 1)).alias("name"), value(m).alias("value")))


def _value(attributes: Column, name: str) -> Column:
    """The value of the first attribute of a name, or null."""
    return F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"]


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` from every canonical link and meta refresh of a page; relative targets are resolved on its first ``<base>`` or URL.

    Attributes are read whole, ``rel`` is a list of tokens, the first attribute of a
    name counts, character references are decoded, and tags inside comments, scripts
    and style sheets do not count.
    """
    shown = F.regexp_replace("html", HIDDEN, " ")
    tags = pages.where("url is not null and html is not null").select("url", F.posexplode(F.regexp_extract_all(shown, F.lit(_TAG), F.lit(0))).alias("at", "tag"))
    tags = tags.select("url", "at", F.lower(F.regexp_extract("tag", r"^<(\w+)", 1)).alias("kind"), _attributes(F.col("tag")).alias("a"))
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower(F.coalesce(_value(F.col("a"), "rel"), F.lit(""))), r"[\t\n\f\r ]+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.lower(F.trim(_value(F.col("a"), "http-equiv"))) == "refresh")
    href = plain(F.trim(_value(F.col("a"), "href")))
    to = F.when(canonical, href).when(refresh, F.regexp_extract(plain(_value(F.col("a"), "content")), REFRESH, 1))
    found = tags.select("url", "at", to.alias("to"), F.when(F.col("kind") == "base", href).alias("base"))
    found = materialize(found.where("coalesce(`to`, '') <> '' or coalesce(base, '') <> ''"))  # links are few; pages are read once
    based = found.where("base <> ''").groupBy("url").agg(F.min_by("base", F.struct("at", "base")).alias("base"))
    out = found.where("`to` <> ''").select("url", "to").join(based, "url", "left")
    out = out.select("url", "to", F.coalesce(resolved(F.col("base"), F.col("url")), "url").alias("base"))
    out = out.select(page_of(F.col("url")).alias("src"), page_of(resolved(F.col("to"), F.col("base"))).alias("dst"))
    return out.where("dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page row.

    A page's own rule decides.  Without one, the page takes ``block`` if a URL of
    its redirect-equivalence class is blocked and none is explicitly allowed, else
    ``allow``.  Classes are connected components over canonical links, meta
    refreshes and the rows of ``redirects(src, dst)``; fragments and the case of
    scheme and host make no difference.  Null URLs, and those without ``://``, have empty host and path, fit no rule and
    have no aliases; repeated rows stay; null HTML gives no edges; an empty table
    gives no rows; columns besides ``page_id``, ``url`` and ``html`` are ignored.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(page_of(F.col("src")).alias("src"), page_of(F.col("dst")).alias("dst"))).distinct()
    parts = materialize(connected_components(materialize(edges), "src", "dst"))
    rule = longest_rule(host_of("node"), path_of("node"), rules)
    decided = parts.select("component", rule["verdict"].alias("own")).groupBy("component").agg(
        F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed")
    )
    spread = decided.where("blocked and not coalesce(allowed, false)").select("component")
    aliases = materialize(parts.join(spread, "component", "left_semi").select(F.col("node").alias("bare"), F.lit("block").alias("by_alias")))
    own = pages.select("page_id", page_of(F.col("url")).alias("bare"), host_of("url").alias("host"), path_of("url").alias("path"))
    own = own.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    out = own.join(aliases, "bare", "left")
    return out.select("page_id", "host", "path", "r.rule", F.coalesce("r.verdict", "by_alias", F.lit("allow")).alias("verdict"))
