"""The text and URL functions under SQL names, for queries that are written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SQUEEZED = r"trim(regexp_replace({}, r'[\s\x{{00A0}}]+', ' '))"

#: name, arguments, body; later ones may use those before them.
FUNCTIONS = (
    ("url_domain", "url STRING", r"regexp_replace(regexp_replace(lower(url), r'^https?://(www\.)?', ''), r'[/?#].*$', '')"),
    ("content_hash", "c STRING", "substring(sha2(CAST(lower(trim(c)) AS BINARY), 256), 1, 32)"),
    ("similarity_text", "c STRING", _SQUEEZED.format(r"regexp_replace(regexp_replace(lower(coalesce(c, '')), '<[^>]+>', ' '), r'[\p{{P}}\p{{S}}]', ' ')").replace("{{", "{").replace("}}", "}")),
    (
        "strip_markup", "c STRING",
        _SQUEEZED.format(
            r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(c, ''), '<[^>]+>', ' '), r'(?m)^\s*[-*+]\s+', ''), r'(?m)^#+\s+', ''), r'\*\*(.*?)\*\*', '$1'), r'\[([^\]]+)\]\([^)]+\)', '$1'), '[*_`>#]', '')"
        ),
    ),
    ("cut_at_word", "head STRING", "CASE WHEN instr(head, ' ') > 0 AND length(head) - instr(reverse(head), ' ') > 80 THEN substring(head, 1, length(head) - instr(reverse(head), ' ')) ELSE head END"),
    (
        "shorten", "clean STRING",
        r"CASE WHEN length(clean) <= 200 THEN clean WHEN trim(regexp_extract(clean, r'^(.{70,200}?[.!?])\s', 1)) <> '' THEN trim(regexp_extract(clean, r'^(.{70,200}?[.!?])\s', 1)) ELSE concat(trim(cut_at_word(substring(clean, 1, 197))), '...') END",
    ),
    ("normalize_tldr", "c STRING", "shorten(strip_markup(c))"),
)


def register(spark: SparkSession) -> None:
    """Create the functions in the session, in place of earlier ones of the same names."""
    for name, arguments, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS STRING RETURN {body}")
