"""Access logs and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.classify import is_bot
from corpusflow.functions.text import squeeze

# Fixed value: the combined log form.
COMBINED = r'^(\S+) \S+ \S+ \[(\d{2})/([A-Za-z]{3})/(\d{4}):[^\]]+\] "([A-Z]+) ([^"]*?) [^"]*" (\d{3}) \S+ "[^"]*" "([^"]*)"'
INTERNAL_IPS = ("127.0.0.1", "::1")
#: Stands between the parts of a line; a control character that log lines do not hold.
CUT = "\x01"


def read_access_log(spark: SparkSession, glob: str) -> DataFrame:
    """Log lines of plain, rotated and gzipped files; of a file that is broken, the lines before the break."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(glob)


def parse_access_log(lines: DataFrame, internal: tuple[str, ...] = INTERNAL_IPS) -> DataFrame:
    """``ip, date, method, path, status, is_bot, is_internal``; other lines are dropped, dates are as written."""
    cut = F.split(F.regexp_replace(F.replace("value", F.lit(CUT), F.lit("")), rf"(?s){COMBINED}.*$", CUT.join(f"${i}" for i in range(1, 9))), CUT, -1)
    rows = lines.select(F.explode(F.array(cut)).alias("p")).where(F.size("p") == 8)  # the line is matched once, for all parts
    part = lambda i: F.col("p")[i - 1]
    date = F.try_to_date(F.concat_ws("/", part(2), part(3), part(4)), "dd/MMM/yyyy")
    return rows.select(
        part(1).alias("ip"), date.alias("date"), part(5).alias("method"), part(6).alias("path"), part(7).cast("int").alias("status"),
        is_bot(part(8), part(6)).alias("is_bot"), part(1).isin(*internal).alias("is_internal"),
    ).where("date is not null")


def vtt_text(c: Column) -> Column:
    """WebVTT without header, cue times and tags."""
    out = F.regexp_replace(c, r"(?m)^(WEBVTT.*|NOTE.*|\d+|(\d{2}:)?\d{2}:\d{2}\.\d{3} --> .*)$", " ")
    return squeeze(F.regexp_replace(out, r"<[^>]+>", " "))


def timed_text(c: Column) -> Column:
    """The text segments of a timed-text document joined, entities decoded twice."""
    joined = F.array_join(F.regexp_extract_all(c, F.lit(r"(?s)<text[^>]*>(.*?)</text>"), F.lit(1)), " ")
    for _ in range(2):
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            joined = F.replace(joined, F.lit(name), F.lit(char))
    return squeeze(joined)


def english_track(tracks: Column) -> Column:
    """The first track whose language is English, else the first."""
    english = F.filter(tracks, lambda t: F.lower(t["lang"]).startswith("en"))
    return F.coalesce(F.try_element_at(english, F.lit(1)), F.try_element_at(tracks, F.lit(1)))
