"""Queue and pipeline state transitions as next-snapshot plans; every changed row gets ``updated_at = as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.classify import failure_backoff_minutes, fetch_error, matches_retry_pattern, next_delay_minutes
from corpusflow.operators.merge import merge

MAX_RETRIES = 3
STALE_REASON = "stale discovered job"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _before(ts: str, as_of: Column, interval: str) -> Column:
    return F.col(ts) < as_of - F.expr(f"INTERVAL {interval}")


def change(rows: DataFrame, where: Column, values: dict[str, Column], as_of: Column) -> DataFrame:
    """Rows with the values set where the test is true."""
    test = F.coalesce(where, F.lit(False))
    new = {c: F.when(test, v).otherwise(F.col(c)) for c, v in {**values, "updated_at": as_of}.items() if c in rows.columns}
    return rows.withColumns(new)


def change_ids(rows: DataFrame, ids: DataFrame, values: dict[str, Column], as_of: Column) -> DataFrame:
    """As ``change``, for the rows whose id is in ``ids`` (a bounded top-k, so the join is a broadcast)."""
    picked = ids.select("id", F.lit(True).alias("__hit"))
    return change(rows.join(picked, "id", "left"), F.col("__hit"), values, as_of).drop("__hit")


def claim_jobs(jobs: DataFrame, as_of: Column, limit: int = 30) -> DataFrame:
    top = jobs.where("status = 'discovered'").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return change_ids(jobs, top, {"status": F.lit("fetching"), "last_error": _null("string")}, as_of)


def claimed_with_sources(jobs: DataFrame, sources: DataFrame, limit: int = 30) -> DataFrame:
    top = jobs.where("status = 'discovered'").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return top.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type")), "source_id")


def claim_summaries(articles: DataFrame, as_of: Column, limit: int = 30) -> DataFrame:
    top = articles.where("summary_status = 'pending'").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return change_ids(articles, top, {"summary_status": F.lit("processing")}, as_of)


def _cleared() -> dict[str, Column]:
    return {"error_type": _null("string"), "last_http_status": _null("int"), "next_attempt_at": _null("timestamp")}


def expire_jobs(jobs: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Discovered jobs older than ``hours`` are skipped, but for rescues and manual saves."""
    free = (F.coalesce(F.get_json_object("payload_json", "$.rescueArticleId"), F.lit("")) == "") & (F.coalesce(F.get_json_object("payload_json", "$.isManualSave"), F.lit("false")) != "true")
    old = (F.col("status") == "discovered") & _before("created_at", as_of, f"{hours} HOURS") & free
    return change(jobs, old, {"status": F.lit("skipped"), "skip_reason": F.lit(STALE_REASON), "last_error": _null("string"), **_cleared()}, as_of)


def unstick_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    stuck = (F.col("status") == "fetching") & _before("updated_at", as_of, "10 MINUTES")
    return change(jobs, stuck, {"status": F.lit("discovered"), "last_error": F.lit("Reset stale fetching state"), "skip_reason": _null("string"), **_cleared()}, as_of)


def unstick_summaries(articles: DataFrame, as_of: Column) -> DataFrame:
    stuck = (F.col("summary_status") == "processing") & _before("updated_at", as_of, "10 MINUTES")
    return change(articles, stuck, {"summary_status": F.lit("pending"), "last_summary_error": F.lit("Reset stale processing state")}, as_of)


def retry_jobs(jobs: DataFrame, as_of: Column, limit: int = 15) -> DataFrame:
    ok = (
        (F.col("status") == "failed") & (F.col("retry_count") < MAX_RETRIES) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of))
        & ~F.coalesce("error_type", F.lit("unknown")).isin("not_found", "invalid_url") & _before("updated_at", as_of, "10 MINUTES")
    )
    top = jobs.where(ok).orderBy("updated_at", "id").limit(limit)
    return change_ids(jobs, top, {"status": F.lit("discovered"), "skip_reason": _null("string"), **_cleared()}, as_of)


def retry_summaries(articles: DataFrame, as_of: Column, limit: int = 15) -> DataFrame:
    ok = (F.col("summary_status") == "failed") & (F.col("retry_count") < MAX_RETRIES) & matches_retry_pattern(F.col("last_summary_error")) & _before("updated_at", as_of, "10 MINUTES")
    top = articles.where(ok).orderBy("updated_at", "id").limit(limit)
    return change_ids(articles, top, {"summary_status": F.lit("pending")}, as_of)


def job_outcomes(jobs: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Apply ``outcomes(id, outcome, error)``: done, failed (one more try, error class, again in ten minutes) or skipped."""
    o = outcomes.select("id", "outcome", "error")
    kind = fetch_error(F.col("c.error"))
    failed, skipped = F.col("c.outcome") == "failed", F.col("c.outcome") == "skipped"
    values = {
        "status": F.col("c.outcome"), "retry_count": F.when(failed, F.col("t.retry_count") + 1).otherwise(F.col("t.retry_count")),
        "last_error": F.when(failed, F.substring("c.error", 1, 500)), "error_type": F.when(failed, kind["type"]), "last_http_status": F.when(failed, kind["http_status"]),
        "next_attempt_at": F.when(failed & kind["retryable"], as_of + F.expr("INTERVAL 10 MINUTES")), "skip_reason": F.when(skipped, F.substring("c.error", 1, 500)), "updated_at": as_of,
    }
    return merge(jobs, o, ["id"], values, insert=False)


def short_content(articles: DataFrame, jobs: DataFrame, sources: DataFrame, limit: int = 30, least: int = 500) -> DataFrame:
    """Skipped short articles of feed and web sources for which no rescue job exists, newest first."""
    known = jobs.select("source_id", "url", F.get_json_object("payload_json", "$.rescueArticleId").alias("__id")).where("__id is not null")
    length = F.greatest(F.length(F.coalesce("raw_content", F.lit(""))), F.length(F.coalesce("raw_excerpt", F.lit(""))))
    rows = articles.where((F.col("summary_status") == "skipped") & F.col("last_summary_error").ilike("%source content too short%") & (length < least))
    rows = rows.join(sources.where(F.col("type").isin("rss", "web")).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    rows = rows.withColumn("__id", F.col("id").cast("string")).join(known, ["source_id", "url", "__id"], "left_anti")
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit).select("id", "source_id", "url", "title")


def requeue(jobs: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Enqueue again: a job of the same source and URL is reset only if it is done or skipped."""
    fresh = {
        "status": F.lit("discovered"), "retry_count": F.lit(0), "last_error": _null("string"), "skip_reason": _null("string"), **_cleared(),
        "payload_json": F.col("c.payload_json"), "updated_at": as_of,
    }
    new = items.withColumns({"status": F.lit("discovered"), "retry_count": F.lit(0), "created_at": as_of, "updated_at": as_of})
    return merge(jobs, new, ["source_id", "url"], fresh, when=F.col("t.status").isin("done", "skipped"))


def apply_rescue(articles: DataFrame, contents: DataFrame, as_of: Column) -> DataFrame:
    """Overwrite the content of articles and put them back to pending, their summary fields cleared."""
    values = {
        "raw_content": F.col("c.raw_content"), "raw_excerpt": F.substring("c.raw_content", 1, 500), "summary_text": _null("string"), "tldr": _null("string"),
        "summary_short": _null("string"), "hot_score": _null("int"), "summary_status": F.lit("pending"), "last_summary_error": _null("string"), "updated_at": as_of,
    }
    return merge(articles, contents.select("id", "raw_content"), ["id"], values, insert=False)


def summary_outcomes(articles: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Apply ``outcomes(id, outcome, tldr, error)``: done with its tldr, skipped, or failed with one more try."""
    done, failed = F.col("c.outcome") == "done", F.col("c.outcome") == "failed"
    values = {
        "summary_status": F.col("c.outcome"), "tldr": F.when(done, F.col("c.tldr")).otherwise(F.col("t.tldr")),
        "retry_count": F.when(failed, F.col("t.retry_count") + 1).otherwise(F.col("t.retry_count")),
        "last_summary_error": F.when(~done, F.substring("c.error", 1, 500)), "updated_at": as_of,
    }
    return merge(articles, outcomes.select("id", "outcome", "tldr", "error"), ["id"], values, insert=False)


def source_outcomes(sources: DataFrame, runs: DataFrame, as_of: Column, manual: bool = False) -> DataFrame:
    """Apply ``runs(id, threw, n_errors)``: next run and failure count.

    A scheduled run resets failures unless it threw; a manual run counts an error list as a failure too.
    """
    bad = F.col("c.threw") | ((F.col("c.n_errors") > 0) if manual else F.lit(False))
    failures = F.when(bad, F.col("t.consecutive_failures") + 1).otherwise(F.lit(0))
    minutes = F.col("t.fetch_interval_minutes").cast("string")
    delay = F.when(bad, failure_backoff_minutes(minutes, F.col("t.consecutive_failures") + 1)).otherwise(next_delay_minutes(minutes, F.col("c.n_errors") > 0))
    values = {
        "consecutive_failures": failures, "next_run_at": F.timestamp_seconds(F.unix_timestamp(as_of) + delay * 60),
        "last_success_at": F.when(bad, F.col("t.last_success_at")).otherwise(as_of),
    }
    return merge(sources, runs.select("id", "threw", "n_errors"), ["id"], values, insert=False)


def due_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    rows = sources.where(F.col("is_enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of)))
    return rows.orderBy(F.coalesce("next_run_at", "created_at"), "name")


def retain_logs(logs: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    return logs.where(F.col("started_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def retain_content(articles: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    old = _before("created_at", as_of, f"{days} DAYS")
    return articles.withColumn("raw_content", F.when(~old, F.col("raw_content")))


def refresh_candidates(articles: DataFrame, is_forum: Column, as_of: Column, limit: int = 30) -> DataFrame:
    young = F.col("created_at").between(as_of - F.expr("INTERVAL 4 HOURS"), as_of)
    rows = articles.where(is_forum & young & (F.coalesce("rescraped_count", F.lit(0)) < 2))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def apply_refresh(articles: DataFrame, texts: DataFrame, as_of: Column) -> DataFrame:
    """New thread texts: taken if changed and longer than 100 characters; the count rises either way."""
    take = (F.length("c.raw_content") > 100) & ~F.col("c.raw_content").eqNullSafe(F.col("t.raw_content"))
    values = {
        "raw_content": F.when(take, F.col("c.raw_content")).otherwise(F.col("t.raw_content")), "rescraped_count": F.coalesce("t.rescraped_count", F.lit(0)) + 1,
        "updated_at": as_of,
    }
    return merge(articles, texts.select("id", "raw_content"), ["id"], values, insert=False)


def empty_threads(articles: DataFrame, as_of: Column, marker: str, limit: int = 10) -> DataFrame:
    rows = articles.where(F.col("raw_content").contains(marker) & (F.col("created_at") >= as_of - F.expr("INTERVAL 48 HOURS")))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def set_saved(articles: DataFrame, edits: DataFrame, as_of: Column) -> DataFrame:
    return merge(articles, edits.select("id", "is_saved"), ["id"], {"is_saved": F.col("c.is_saved"), "updated_at": as_of}, insert=False)
