"""Classifying expressions: promotions, blocked pages, errors, refusals, bots, forum text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import WS, squeeze

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Phrases of promotional titles, in the order in which they are tried.
PROMO_PHRASES = (
    r"\b\d+\s*percent\s+off\b",
    r"\b\d+%\s*off\b",
    r"\bon sale\s+(for|at|now)\b",
    r"\balready on sale\b",
    r"\b(lowest price|all[- ]time low|price drop|price cut)\b",
    r"\bsave \$\d+",
    r"\bsave up to \d+",
    r"\b(best|top|daily|today'?s|this week'?s)\s+[a-z0-9][a-z0-9 -]{0,40}\s+deal[s]?\b",
    r"\bdeal[s]?\s+(of the day|under \$\d+|for less|on sale)\b",
    r"\b(coupons?|promo codes?|discount codes?|coupon codes?|vouchers?)\b",
    r"\b(clearance|doorbuster)\b",
    r"\b(buy now|shop now|grab this|order now|get it now)\b",
    r"(?:^|\s)giảm\s*giá(?:\s|$)",
    r"(?:^|\s)khuyến\s*m[ãạ]i(?:\s|$)",
    r"(?:^|\s)mua ngay(?:\s|$)",
    r"(?:^|\s)giá rẻ nhất(?:\s|$)",
    r"\bflash sale\b",
)
PROMO_HINTS = (
    r"\b(deal[s]?|sale|discount|coupon|voucher|promo code|price drop|price cut|lowest price|all[- ]time low)\b",
    r"\b(save|off)\b.*(?:\$|\d+%|\d+ percent)",
    r"(?:^|\s)(giảm\s*giá|khuyến\s*m[ãạ]i|mua ngay|giá rẻ|ưu đãi)(?:\s|$)",
)
# Markers of challenge pages.
BLOCK_MARKERS = (
    "just a moment...", "<title>blocked</title>", "challenges.cloudflare.com", "cf-browser-verification", "access denied", "token.awswaf.com",
    "awswafintegration", "awswafcookiedomainlist", "challenge-container", "captcha-delivery.com", "geo.captcha-delivery.com", "datadome",
    "_pxhd", "px-captcha", "perimeterx", "verify that you're not a robot",
)
EMPTY_PAGE_MARKERS = ("just a moment", "access denied", "captcha", "cloudflare", "datadome", "perimeterx", "verify you are human", "enable javascript")
# Parts of errors that are worth another try.
RETRYABLE = (
    "timeout", "timed out", "aborted", "408", "429", "500", "502", "503", "504", "524", "rate limit", "too many requests", "econnreset",
    "etimedout", "socket hang up", "<!doctype html",
)
RETRYABLE_WORDS = tuple(m for m in RETRYABLE if not m.isdigit())
HTTP_STATUSES = "400|401|403|404|408|410|429|500|502|503|504|524"
# Error categories of the statistics, first match wins.
ERROR_CATEGORIES = (
    ("Cloudflare/antibot", ("cloudflare", "challenge", "just a moment")),
    ("Timeout", ("timeout", "timed out", "etimedout", "aborted")),
    ("Rate limit", ("429", "rate limit", "too many")),
    ("403 Forbidden", ("403", "forbidden")),
    ("404 Not found", ("404", "not found")),
    ("Lỗi server (5xx)", ("502", "503", "500", "504", "bad gateway")),
    ("Paywall", ("paywall", "subscri")),
    ("Nội dung rỗng/ngắn", ("empty", "no content", "too short")),
)
UNKNOWN_CATEGORY, OTHER_CATEGORY = "Không rõ", "Khác"
# Refusals, sensitive topics, noise comments, experience words.
REFUSAL_START = r"^(?:i(?:'|’)?m sorry|sorry|i can(?:'|’)?t|i cannot|i am unable|i(?:'|’)?m unable|tôi xin lỗi|xin lỗi|tôi không thể|mình không thể)"
REFUSAL_TOPIC = (
    r"(?:assist|help|summari[sz]e|request|policy|sensitive|minor|child|sexual|hỗ trợ|tóm tắt|yêu cầu|chính sách|nhạy cảm|trẻ vị thành niên|trẻ em|tình dục)"
)
MINOR_SIGNAL = r"\b(?:child|minor|underage|teen(?:ager)?|preteen|aged\s+(?:[0-9]|1[0-7]))\b|trẻ\s+em|vị\s+thành\s+niên|chưa\s+thành\s+niên"
SEXUAL_SIGNAL = (
    r"\b(?:dated?|dating|relationship|sex(?:ual)?|slept\s+with|groom(?:ing)?|molest(?:ed|ation)?|rape|abuse|assault)\b"
    r"|hẹn\s+hò|quan\s+hệ|tình\s+dục|xâm\s+hại|ấu\s+dâm"
)
NOISE_START = (
    r"^([+\-]?1|lol|lmao|haha|hihi|ok|okay|thanks|thank you|first|up|bump|subscribed|following|hóng|hóng\.|chấm|\.)(\s|[.!?])*$"
)
NOISE_WORD = r"^(same|this|agree|đúng|chuẩn|hay|ngon|tuyệt|vl|vãi|haha|hahaha|kkk|:v|=\))$"
EXPERIENCE = r"\?|\b(i|i'm|i’ve|we|my|our|tôi|mình|em|anh|team|công ty|kinh nghiệm|dùng|thử|triển khai)\b"
# User agents of bots, and paths that scanners probe.
BOT_AGENTS = (
    "bot|crawl|spider|slurp|bingpreview|mediapartners|facebookexternalhit|embedly|monitor|uptime|pingdom|headless|python-requests|curl|wget|go-http|"
    r"node|axios|okhttp|java\/|libwww|scrapy|semrush|ahrefs|dotbot|petalbot"
)
SCANNER_PATHS = (
    r"(^|\/)\.(env|git|aws|ssh|npmrc|htpasswd)\b|\/\.(env|git|aws)\/|wp-(config|content|admin|login|includes|json)|xmlrpc\.php|\/actuator\b|phpinfo|"
    r"\/vendor\/|\/cgi-bin\/|\.\.(\/|%2f)|credentials(\.json)?|id_rsa|\/boaform|\/manager\/html|\/solr\/|_ignition|\/\.well-known\/.*\.(env|git)|"
    r"\.(sql|bak|old|save|swp)\b|\bwww\.zip\b|\/backend\/\.env|\/laravel\/\.env|\/app\/\.env"
)


def ascii_bounds(pattern: str) -> str:
    r"""``\b`` as a border of ASCII words, whatever the regex engine takes for a letter."""
    return pattern.replace(r"\b", f"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def promo_phrase(title: Column) -> Column:
    """The first promotional phrase of a title in letters of any case, or null."""
    hits = [F.nullif(F.regexp_extract(title, "(?iu)" + ascii_bounds(p), 0), F.lit("")) for p in PROMO_PHRASES]
    return F.coalesce(*hits)


def has_promo_hint(title: Column, excerpt: Column) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(excerpt, F.lit("")), 1, 400))
    out = F.lit(False)
    for p in PROMO_HINTS:
        out = out | text.rlike("(?iu)" + ascii_bounds(p))
    return out


def _any(text: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def is_blocked_page(html: Column) -> Column:
    return (F.length(html) <= 50_000) & _any(F.lower(html), BLOCK_MARKERS)


def is_blocked_or_empty(html: Column) -> Column:
    return (F.length(F.coalesce(html, F.lit(""))) < 500) | _any(F.lower(F.substring(html, 1, 4000)), EMPTY_PAGE_MARKERS)


def error_category(error: Column) -> Column:
    out = None
    for name, parts in ERROR_CATEGORIES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | error.ilike(f"%{p}%")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(error.isNull() | (F.trim(error) == ""), UNKNOWN_CATEGORY).otherwise(OTHER_CATEGORY)


# Types of fetch errors, first match wins: parts of the text, HTTP statuses, type.
FETCH_ERRORS = (
    (("url must be a public http", "invalid url"), (), "invalid_url"),
    ((), (404, 410), "not_found"),
    ((), (429,), "rate_limited"),
    ((), (408,), "timeout"),
    ((), (500, 502, 503, 504, 524), "server_error"),
    (("timeout", "timed out", "aborted"), (), "timeout"),
    (("econnreset", "etimedout", "socket hang up"), (), "connection"),
    (("blocked", "cloudflare", "datadome", "challenge"), (), "blocked"),
)
FINAL_ERRORS = ("invalid_url", "not_found")


def fetch_error(error: Column) -> Column:
    """``struct(type, retryable, http_status)`` of a fetch error."""
    m = F.lower(F.coalesce(error, F.lit("")))
    status = F.regexp_extract(m, _B + f"({HTTP_STATUSES})" + _E, 1).try_cast("int")
    kind = F.lit("unknown")
    for words, statuses, name in reversed(FETCH_ERRORS):
        kind = F.when(_any(m, words) if words else status.isin(*statuses), name).otherwise(kind)
    return F.struct(kind.alias("type"), (~kind.isin(*FINAL_ERRORS)).alias("retryable"), status.alias("http_status"))


def is_retryable_ai_error(error: Column) -> Column:
    m = F.lower(F.coalesce(error, F.lit("")))
    return m.rlike(_B + "(408|429|500|502|503|504|524)" + _E) | _any(m, RETRYABLE_WORDS)


def matches_retry_pattern(error: Column) -> Column:
    return _any(F.lower(F.coalesce(error, F.lit(""))), RETRYABLE)


def is_refusal(output: Column) -> Column:
    t = squeeze(output)
    return (t != "") & (F.length(t) <= 1200) & t.rlike("(?iu)" + REFUSAL_START) & t.rlike("(?iu)" + REFUSAL_TOPIC)


def is_safety_rejection(error: Column) -> Column:
    return F.coalesce(error, F.lit("")).rlike("(?i)safety|high-risk|rejected")


def is_sensitive_topic(title: Column, excerpt: Column) -> Column:
    t = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(excerpt, F.lit(""))))
    return t.rlike(ascii_bounds(MINOR_SIGNAL)) & t.rlike(ascii_bounds(SEXUAL_SIGNAL))


def is_forum_article(url: Column, name: Column, title: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(name, F.lit("")))
    return both.rlike("(?i)voz|reddit") | F.coalesce(title, F.lit("")).startswith("[r/")


def is_useful_comment(body: Column) -> Column:
    """45 characters, eight words, six different ones, and no noise phrase."""
    t = squeeze(body)
    words = F.split(t, " ")
    distinct = F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), lambda w: w != ""))
    noise = F.lower(t).rlike(NOISE_START) | F.lower(t).rlike(NOISE_WORD)
    return (F.length(t) >= 45) & ~noise & (F.size(words) >= 8) & (F.size(distinct) >= 6)


def comment_key(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(squeeze(body)), r"[^\p{L}\p{N}\s]", ""))


def comment_score(body: Column, reactions: Column, page: Column, order: Column) -> Column:
    t = squeeze(body)
    return (
        F.least(reactions, F.lit(50)) * F.lit(0.35)
        + F.least(F.length(t) / F.lit(140.0), F.lit(4.0))
        + F.when(page == 1, 1.2).otherwise(0.0)
        + F.when(order < 8, 0.6).otherwise(0.0)
        + F.when(F.lower(t).rlike(ascii_bounds(EXPERIENCE)), 0.8).otherwise(0.0)
    )


def is_bot(agent: Column, path: Column) -> Column:
    return F.coalesce(agent, F.lit("")).rlike("(?i)" + BOT_AGENTS) | F.coalesce(path, F.lit("")).rlike("(?i)" + ascii_bounds(SCANNER_PATHS))


def cjk_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^㐀-鿿豈-﫿]", ""))


def min_text_length(language: Column, content: Column, excerpt: Column, base: int = 500) -> Column:
    """450 characters, or 160 for CJK languages and texts with 160 CJK letters; never above ``base``."""
    both = F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(excerpt, F.lit("")))
    cjk = F.coalesce(language, F.lit("")).rlike("(?i)^(zh|ja|ko)(-|$)") | (cjk_count(both) >= 160)
    return F.when(cjk, min(base, 160)).otherwise(min(base, 450))


def long_enough(language: Column, content: Column, excerpt: Column, content_type: Column, base: int = 500) -> Column:
    n = F.greatest(F.length(squeeze(content)), F.length(squeeze(excerpt)))
    return (content_type == "video") | (n >= min_text_length(language, content, excerpt, base))


def is_usable_extraction(content: Column, least: int = 500) -> Column:
    t = squeeze(content)
    chunks = F.size(F.filter(F.split(t, r"[.!?。！？]\s+"), lambda p: F.length(F.trim(p)) > 30))
    return (F.length(t) >= least) & (F.size(F.split(t, " ")) >= 80) & ((chunks >= 2) | (F.length(t) >= 2 * least))


def interval_minutes(value: Column, default: int = 60) -> Column:
    n = value.try_cast("double")
    return F.when(n.isNull() | (n <= 0), default).otherwise(F.greatest(F.lit(5), F.floor(n + F.lit(0.5)))).cast("int")


def next_delay_minutes(value: Column, has_errors: Column) -> Column:
    base = interval_minutes(value)
    return F.when(has_errors, F.least(base * 2, F.lit(1440))).otherwise(base)


def failure_backoff_minutes(value: Column, failures: Column) -> Column:
    base = interval_minutes(value)
    return F.least(base * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))), F.lit(1440.0)).cast("int")


def jitter(minutes: Column, key: Column) -> Column:
    """Up to a tenth (2 to 10 minutes) either way, fixed by a hash of the key; none up to 10 minutes."""
    window = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(minutes * F.lit(0.1)))).cast("int")
    shift = F.pmod(F.crc32(key.cast("string").cast("binary")), (window * 2 + 1).cast("long")).cast("int") - window
    return F.when(minutes <= 10, minutes).otherwise(F.greatest(F.lit(5), minutes + shift))
