"""Pipeline statistics, health and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.classify import error_category
from corpusflow.functions.dates import local_date, local_date_text
from corpusflow.functions.url import domain
from corpusflow.runtime import global_rank, materialize

UNKNOWN_DOMAIN = "(không rõ)"
QUALITY_STATUSES = ("healthy", "low_yield", "failing", "stale", "disabled")


def in_days(ts: str, start: str, end: str) -> Column:
    return local_date(F.col(ts)).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def by_domain(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias(name))


def by_day(rows: DataFrame, ts: str, name: str = "n") -> DataFrame:
    return rows.groupBy(local_date_text(F.col(ts)).alias("date")).agg(F.count(F.lit(1)).alias(name))


def domain_table(articles: DataFrame, jobs: DataFrame, start: str, end: str) -> DataFrame:
    """Articles, failed fetches and skipped articles per domain, with the success rate; one aggregate over a union."""
    a = articles.where(in_days("created_at", start, end)).select(
        domain(F.col("url")).alias("domain"), F.lit(1).alias("articles"), F.lit(0).alias("fetch_failed"), (F.col("summary_status") == "skipped").cast("int").alias("skipped")
    )
    j = jobs.where((F.col("status") == "failed") & in_days("updated_at", start, end)).select(
        domain(F.col("url")).alias("domain"), F.lit(0).alias("articles"), F.lit(1).alias("fetch_failed"), F.lit(0).alias("skipped")
    )
    key = F.coalesce(F.nullif("domain", F.lit("")), F.lit(UNKNOWN_DOMAIN)).alias("domain")
    out = a.unionByName(j).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("articles", "fetch_failed", "skipped")])
    return out.withColumn("success_rate", F.try_divide("articles", F.col("articles") + F.col("fetch_failed")))


def success_rates(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """Share of finished fetches that succeeded, per source; null where none is finished."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    return jobs.where(in_days("updated_at", start, end)).groupBy("source_id").agg(F.try_divide(done, done + failed).alias("success_rate"))


def with_runs(sources: DataFrame, logs: DataFrame) -> DataFrame:
    """Sources with the number of their runs and the last one; logs are summed before the join."""
    sums = logs.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("last_run"))
    return sources.join(sums, "id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def daily_table(articles: DataFrame, jobs: DataFrame, start: str, end: str) -> DataFrame:
    a = by_day(articles.where(in_days("created_at", start, end)), "created_at", "articles")
    j = by_day(jobs.where((F.col("status") == "failed") & in_days("updated_at", start, end)), "updated_at", "fetch_failed")
    return a.join(j, "date", "full_outer").select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "fetch_failed")])


def error_counts(jobs: DataFrame, start: str, end: str) -> DataFrame:
    rows = jobs.where((F.col("status") == "failed") & in_days("updated_at", start, end))
    return rows.groupBy(error_category(F.col("last_error")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def status_by_day(articles: DataFrame, start: str, end: str) -> DataFrame:
    rows = articles.where(in_days("created_at", start, end))
    return rows.groupBy(local_date_text(F.col("created_at")).alias("date")).agg(*[F.count_if(F.col("summary_status") == s).alias(s) for s in ("done", "failed", "skipped")])


def silent_domains(articles: DataFrame, start: str, end: str, limit: int = 15) -> DataFrame:
    """Domains with articles in the 30 days before the range and none in it."""
    first = F.lit(start).cast("date")
    seen = articles.where(in_days("created_at", start, end)).select(domain(F.col("url")).alias("domain")).distinct()
    day = local_date(F.col("created_at"))
    prior = articles.where(day.between(F.date_sub(first, 30), F.date_sub(first, 1))).groupBy(domain(F.col("url")).alias("domain"))
    prior = prior.agg(F.count(F.lit(1)).alias("prior_count"), F.date_format(F.max(day), "yyyy-MM-dd").alias("last_seen")).where("domain <> ''")
    return prior.join(seen, "domain", "left_anti").orderBy(F.col("prior_count").desc(), "domain").limit(limit)


def totals(articles: DataFrame, jobs: DataFrame, start: str, end: str) -> DataFrame:
    a = articles.where(in_days("created_at", start, end)).agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("summary_status") == "skipped").alias("skipped"))
    j = jobs.where(in_days("updated_at", start, end)).agg(F.count_if(F.col("status") == "failed").alias("fetch_failed"))
    return a.crossJoin(j)  # one row each


def source_counters(sources: DataFrame, as_of: Column) -> DataFrame:
    on, failing = F.col("is_enabled"), F.col("consecutive_failures") > 0
    return sources.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(on).alias("enabled"), F.count_if(on & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of))).alias("due"),
        F.count_if(on & failing).alias("failing"), F.count_if(on & failing & (F.col("next_run_at") > as_of)).alias("backed_off"),
    )


def article_counters(articles: DataFrame) -> DataFrame:
    s = F.col("summary_status")
    return articles.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(v) for v in ("pending", "processing", "done", "failed", "skipped")],
        F.count_if((s == "failed") & (F.col("retry_count") < 3)).alias("retryable_failed"),
    )


def job_counters(jobs: DataFrame, as_of: Column) -> DataFrame:
    s = F.col("status")
    oldest = F.min(F.when(s == "discovered", F.unix_timestamp("created_at")))
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(v) for v in ("discovered", "fetching", "done", "failed", "skipped")],
        F.count_if((s == "failed") & (F.col("retry_count") < 3)).alias("retryable_failed"), ((F.unix_timestamp(as_of) - oldest) / 60).alias("oldest_discovered_minutes"),
    )


def forum_totals(logs: DataFrame, as_of: Column) -> DataFrame:
    """Thread counters per forum kind over 24 hours, from the logs' JSON."""
    meta = F.get_json_object("metadata", "$.forum")
    number = lambda k: F.get_json_object("metadata", f"$.forum.{k}").try_cast("int")
    rows = logs.where(meta.isNotNull() & (F.col("started_at") >= as_of - F.expr("INTERVAL 24 HOURS")))
    return rows.groupBy(F.get_json_object("metadata", "$.forum.kind").alias("kind")).agg(
        F.sum(number("threadsSeen")).alias("threads_seen"), F.sum(number("inserted")).alias("inserted"), F.sum(number("fetchErrors")).alias("fetch_errors")
    )


def forum_recent(logs: DataFrame, sources: DataFrame, limit: int = 8) -> DataFrame:
    rows = logs.where(F.get_json_object("metadata", "$.forum").isNotNull())
    top = rows.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)
    return top.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left").select(
        F.col("id"), "source_id", "source_name", "status", "items_found", F.get_json_object("metadata", "$.forum.kind").alias("kind")
    )


def source_quality(sources: DataFrame, logs: DataFrame, as_of: Column) -> DataFrame:
    """Run counters over 24 hours and 7 days, insert rates and the quality status; logs are summed before the join."""
    day = F.col("started_at") >= as_of - F.expr("INTERVAL 24 HOURS")
    recent = logs.where(F.col("started_at") >= as_of - F.expr("INTERVAL 7 DAYS"))
    sums = recent.groupBy("source_id").agg(
        F.count_if(day).alias("runs_24h"), F.sum(F.when(day, F.col("items_found"))).alias("found_24h"), F.sum(F.when(day, F.col("items_inserted"))).alias("inserted_24h"),
        F.count_if(day & (F.col("status") == "failed")).alias("failed_24h"), F.count(F.lit(1)).alias("runs_7d"), F.sum("items_found").alias("found_7d"),
        F.sum("items_inserted").alias("inserted_7d"), F.count_if(F.col("status") == "failed").alias("failed_7d"),
    )
    names = [c for c in sums.columns if c != "source_id"]
    out = sources.join(sums.withColumnRenamed("source_id", "id"), "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    stale = F.col("last_success_at").isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp("last_success_at") > 3 * 86400)
    status = (
        F.when(~F.col("is_enabled"), "disabled").when(F.col("consecutive_failures") > 0, "failing").when(stale, "stale")
        .when((F.col("runs_24h") >= 2) & (F.col("found_24h") > 0) & (F.col("inserted_24h") == 0), "low_yield").otherwise("healthy")
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("id", "name", status.alias("status"), *names, rate("inserted_24h", "found_24h").alias("insert_rate_24h"), rate("inserted_7d", "found_7d").alias("insert_rate_7d"))


def quality_summary(quality: DataFrame) -> DataFrame:
    """Number of sources per quality status, zeros included."""
    known = quality.sparkSession.createDataFrame([(s,) for s in QUALITY_STATUSES], "status string")
    counts = quality.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def top_fetch_errors(jobs: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    rows = jobs.where((F.col("status") == "failed") & (F.col("updated_at") > as_of - F.expr("INTERVAL 24 HOURS")))
    kind, http = F.coalesce("error_type", F.lit("unknown")), F.coalesce(F.col("last_http_status").cast("string"), F.lit(""))
    out = rows.groupBy(kind.alias("error_type"), http.alias("http_status")).agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_seen"))
    out = out.orderBy(F.col("n").desc(), F.col("last_seen").desc(), "error_type", "http_status").limit(limit)
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


def top_summary_errors(articles: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    rows = articles.where((F.col("summary_status") == "failed") & (F.col("updated_at") > as_of - F.expr("INTERVAL 24 HOURS")))
    error = F.substring(F.coalesce("last_summary_error", F.lit("unknown")), 1, 160)
    out = rows.groupBy(error.alias("error")).agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_seen"))
    out = out.orderBy(F.col("n").desc(), F.col("last_seen").desc(), "error").limit(limit)
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


def low_yield(sources: DataFrame, logs: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    sums = logs.where(F.col("started_at") > as_of - F.expr("INTERVAL 24 HOURS")).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("items_found").alias("items_found"), F.sum("items_inserted").alias("items_inserted")
    )
    low = sums.where("coalesce(items_found, 0) >= 20 and coalesce(items_inserted, 0) = 0")
    out = low.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    return out.orderBy(F.col("items_found").desc(), "source_id").limit(limit)


def visits_by_day(visits: DataFrame) -> DataFrame:
    own = visits.where("not is_internal")
    return own.groupBy("date").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_bot")).alias("humans"), F.countDistinct(F.when(~F.col("is_bot"), F.col("ip"))).alias("unique_ips")
    )


def top_ips(visits: DataFrame, limit: int = 30, most_paths: int = 50) -> DataFrame:
    own = visits.where("not is_internal")
    out = own.groupBy("ip").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_bot")).alias("humans"), F.count_if("is_bot").alias("bots"),
        F.least(F.countDistinct("path"), F.lit(most_paths)).alias("paths"),
    )
    return out.orderBy(F.col("total").desc(), "ip").limit(limit)


def visit_totals(visits: DataFrame) -> DataFrame:
    own = visits.where("not is_internal")
    return own.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_bot")).alias("humans"), F.count_if("is_bot").alias("bots"),
        F.countDistinct(F.when(~F.col("is_bot"), F.col("ip"))).alias("unique_ips"),
    )


def failure_streaks(logs: DataFrame) -> DataFrame:
    """Failures of each source since its last success, from two aggregates instead of a window over its whole log."""
    success = logs.where("status <> 'failed'").groupBy("source_id").agg(F.max(F.struct("started_at", "id")).alias("last_success"))
    rows = logs.join(success, "source_id", "left")
    after = F.col("last_success").isNull() | (F.struct("started_at", "id") > F.col("last_success"))
    return rows.groupBy("source_id").agg(F.count_if(after & (F.col("status") == "failed")).alias("failures"))


def quota_admissions(calls: DataFrame, cap: int, key: str = "provider", ts: str = "ts", id_col: str = "id") -> DataFrame:
    """Calls of a key and day in order; the k-th is allowed if k < cap (the count is raised before the test).

    ``k`` is the rank over all calls, slice by slice, less the first rank of its key
    and day, so a key of many calls is not ordered in one task.
    """
    day = F.to_date(ts)
    ranked = global_rank(calls.withColumn("__day", day), [F.col(key), F.col("__day"), F.col(ts), F.col(id_col)], "__rank")
    ranked = materialize(ranked)
    first = ranked.groupBy(F.col(key).alias("__key"), F.col("__day").alias("__on")).agg(F.min("__rank").alias("__first"))
    out = ranked.join(first, F.col(key).eqNullSafe(F.col("__key")) & F.col("__day").eqNullSafe(F.col("__on")))
    out = out.withColumn("k", F.col("__rank") - F.col("__first") + 1).withColumn("allowed", F.col("k") < cap)
    return out.select(*calls.columns, "k", "allowed")


def work_board(metrics: DataFrame, severities: dict[str, int]) -> DataFrame:
    """One row of metrics turned into work items: zeros dropped, the most severe first."""
    long = metrics.unpivot([], list(severities), "item", "n").where("n > 0")
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in severities.items() for x in (k, v)]), F.col("item"))
    return long.select("item", "n", rank.alias("severity")).orderBy("severity", "item")
