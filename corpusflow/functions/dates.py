"""Date expressions: local days, lenient parsing, datelines and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Ho_Chi_Minh"
# Default offsets by language, month numbers, offsets by zone name.
LANGUAGE_OFFSETS = {"vi": "+07:00", "zh": "+08:00"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ZONE_OFFSETS = {
    "JST": "+09:00", "GMT": "+00:00", "UTC": "+00:00", "EST": "-05:00", "EDT": "-04:00",
    "PST": "-08:00", "PDT": "-07:00", "HKT": "+08:00", "SGT": "+08:00", "CST": "+08:00",
}
FREE_FORMS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def local_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, LOCAL_ZONE))


def local_date_text(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, LOCAL_ZONE), "yyyy-MM-dd")


def feed_time(published: str = "published_at", created: str = "created_at") -> Column:
    return F.coalesce(F.col(published), F.col(created))


def default_offset(language: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(LANGUAGE_OFFSETS), F.lower(language)), F.lit("Z"))


def normalize_date(value: Column, offset: Column | str, as_of: Column) -> Column:
    """A timestamp from a lenient text form, null unless the year lies between 2000 and next year."""
    v = F.trim(value)
    offset = F.lit(offset) if isinstance(offset, str) else offset
    iso = (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}$"), F.concat(F.replace(v, F.lit(" "), F.lit("T")), F.lit(":00"), offset))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?| \d{2}:\d{2}:\d{2})$"), F.concat(F.replace(v, F.lit(" "), F.lit("T")), offset))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit("T00:00:00"), offset))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), v)
    )
    plain = F.regexp_replace(v, r"^[A-Za-z]{3,9},\s*", "")  # the weekday of the RFC form
    free = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FREE_FORMS])
    found = F.coalesce(iso.try_cast("timestamp"), free)
    return F.when(F.year(found).between(2000, F.year(as_of) + 1), found)


def dateline_date(text: Column) -> Column:
    """The date of a full ``Month D, YYYY HH:MM TZ`` in the first 4,000 characters, as ISO text."""
    names = "|".join(m.capitalize() for m in MONTHS)
    zones = "|".join(ZONE_OFFSETS)
    pattern = rf"(?i)({names})\s+(\d{{1,2}}),\s*(\d{{4}})\s+(\d{{1,2}}):(\d{{2}})\s*({zones})"
    lede = F.substring(text, 1, 4000)
    part = lambda i: F.regexp_extract(lede, pattern, i)
    month = F.try_element_at(_map({m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)}), F.lower(part(1)))
    zone = F.try_element_at(_map(ZONE_OFFSETS), F.upper(part(6)))
    made = F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("T"), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":00"), zone)
    return F.when(part(1) != "", made)


def clamp_published(published: Column, as_of: Column) -> Column:
    """``struct(published_at, warning)``: a time over two hours ahead becomes ``as_of``, the old one goes to the warning."""
    ahead = published > as_of + F.expr("INTERVAL 2 HOURS")
    warning = F.when(
        ahead,
        F.to_json(F.struct(
            F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss").alias("original_published_at"),
            F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("replacement_published_at"), F.lit(2).alias("tolerance_hours"),
        )),
    )
    return F.struct(F.when(ahead, as_of).otherwise(F.coalesce(published, as_of)).alias("published_at"), warning.alias("warning"))


def date_range(start: str | None, end: str | None, today: str, most_days: int) -> tuple[str, str]:
    """Checked inclusive range of local days; the last seven by default."""
    import datetime as dt

    def parse(name: str, value: str) -> dt.date:
        try:
            return dt.date.fromisoformat(value)
        except ValueError:
            raise ValueError(f"{name} must be YYYY-MM-DD") from None

    to = parse("to", end or today)
    frm = parse("from", start) if start else to - dt.timedelta(days=6)
    if frm > to:
        raise ValueError("from must be <= to")
    if (to - frm).days > most_days:
        raise ValueError(f"range must be <= {most_days} days")
    return frm.isoformat(), to.isoformat()
