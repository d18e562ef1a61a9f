"""Queries over statistics, health, visits, state transitions and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import classify as C
from corpusflow.operators import feed as O
from corpusflow.operators import merge as M
from corpusflow.operators import state as ST
from corpusflow.operators import stats as G
from corpusflow.plans import fixtures as X
from corpusflow.plans.fixtures import AS_OF_SQL, as_of
from corpusflow.plans.q_feed import DOM, LOCAL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = X.with_tables(sql)
        return f

    return put


A, S, J, L, V = X.articles, X.sources, X.jobs, X.logs, X.visits
R = ("2024-01-22", "2024-01-28")
IN_A = f"{LOCAL.format('created_at')} BETWEEN DATE '{R[0]}' AND DATE '{R[1]}'"
IN_J = f"status = 'failed' AND {LOCAL.format('updated_at')} BETWEEN DATE '{R[0]}' AND DATE '{R[1]}'"
DAY = "strftime({} + INTERVAL 7 HOUR, '%Y-%m-%d')"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


query("agg04_articles_by_domain", f"SELECT {DOM} AS domain, count(*) AS articles FROM articles WHERE {IN_A} GROUP BY 1")(lambda s, d: G.by_domain(A(s, d).where(G.in_days("created_at", *R)), "articles"))
query("agg05_failed_by_domain", f"SELECT {DOM} AS domain, count(*) AS fetch_failed FROM jobs WHERE {IN_J} GROUP BY 1")(
    lambda s, d: G.by_domain(J(s, d).where(G.in_days("updated_at", *R) & (F.col("status") == "failed")), "fetch_failed")
)
query("agg05_skipped_by_domain", f"SELECT {DOM} AS domain, count(*) AS skipped FROM articles WHERE summary_status = 'skipped' AND {IN_A} GROUP BY 1")(
    lambda s, d: G.by_domain(A(s, d).where(G.in_days("created_at", *R) & (F.col("summary_status") == "skipped")), "skipped")
)
query("agg06_daily_articles", f"SELECT {DAY.format('created_at')} AS date, count(*) AS n FROM articles WHERE {IN_A} GROUP BY 1")(lambda s, d: G.by_day(A(s, d).where(G.in_days("created_at", *R)), "created_at"))
query("agg06_daily_failures", f"SELECT {DAY.format('updated_at')} AS date, count(*) AS n FROM jobs WHERE {IN_J} GROUP BY 1")(
    lambda s, d: G.by_day(J(s, d).where(G.in_days("updated_at", *R) & (F.col("status") == "failed")), "updated_at")
)
_cases = " ".join("WHEN " + " OR ".join(f"last_error ILIKE '%{p}%'" for p in parts) + f" THEN '{name}'" for name, parts in C.ERROR_CATEGORIES)
query("agg07_error_categories", f"SELECT CASE {_cases} WHEN last_error IS NULL OR trim(last_error) = '' THEN '{C.UNKNOWN_CATEGORY}' ELSE '{C.OTHER_CATEGORY}' END AS category, count(*) AS n FROM jobs WHERE {IN_J} GROUP BY 1")(
    lambda s, d: G.error_counts(J(s, d), *R)
)
query("agg08_status_pivot", f"SELECT {DAY.format('created_at')} AS date, count(*) FILTER (summary_status = 'done') AS done, count(*) FILTER (summary_status = 'failed') AS failed, count(*) FILTER (summary_status = 'skipped') AS skipped FROM articles WHERE {IN_A} GROUP BY 1")(
    lambda s, d: G.status_by_day(A(s, d), *R)
)
# Every article of a source has its host, so hosts get the day's parity to fall silent.
_half = "CASE WHEN id % 3 = 0 THEN replace(url, 'https://', 'https://p' || strftime(created_at, '%d') || '.') ELSE url END AS url, created_at"
query("jn04_silent_domains", f"""WITH h AS (SELECT {_half} FROM articles)
SELECT {DOM} AS domain, count(*) AS prior_count, strftime(max({LOCAL.format('created_at')}), '%Y-%m-%d') AS last_seen FROM h
WHERE {LOCAL.format('created_at')} BETWEEN DATE '{R[0]}' - 30 AND DATE '{R[0]}' - 1 AND {DOM} NOT IN (SELECT {DOM} FROM h WHERE {IN_A}) GROUP BY 1 ORDER BY prior_count DESC, domain LIMIT 15""")(
    lambda s, d: G.silent_domains(A(s, d).withColumn("url", F.when(F.col("id") % 3 == 0, F.replace("url", F.lit("https://"), F.concat(F.lit("https://p"), F.date_format("created_at", "dd"), F.lit(".")))).otherwise(F.col("url"))), *R)
)
query("agg09_prior_domains", f"SELECT {DOM} AS domain, count(*) AS n, strftime(max({LOCAL.format('created_at')}), '%Y-%m-%d') AS last_seen FROM articles WHERE {LOCAL.format('created_at')} < DATE '{R[0]}' GROUP BY 1")(
    lambda s, d: A(s, d).where(G.local_date(F.col("created_at")) < F.lit(R[0]).cast("date")).groupBy(G.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max(G.local_date(F.col("created_at"))), "yyyy-MM-dd").alias("last_seen"))
)
query("agg10_totals", f"SELECT (SELECT count(*) FROM articles WHERE {IN_A}) AS articles, (SELECT count(*) FROM jobs WHERE {IN_J}) AS fetch_failed, (SELECT count(*) FROM articles WHERE summary_status = 'skipped' AND {IN_A}) AS skipped")(
    lambda s, d: G.totals(A(s, d), J(s, d), *R)
)
_dom = f"""WITH u AS (SELECT {DOM} AS domain, 1 AS a, 0 AS f, (summary_status = 'skipped')::INT AS k FROM articles WHERE {IN_A} UNION ALL SELECT {DOM}, 0, 1, 0 FROM jobs WHERE {IN_J})
SELECT coalesce(nullif(domain, ''), '{G.UNKNOWN_DOMAIN}') AS domain, sum(a)::BIGINT AS articles, sum(f)::BIGINT AS fetch_failed, sum(k)::BIGINT AS skipped, sum(a) / nullif(sum(a) + sum(f), 0) AS success_rate FROM u GROUP BY 1"""
query("jn10_domain_merge", _dom)(lambda s, d: G.domain_table(A(s, d), J(s, d), *R))
_worst = f"SELECT source_id, count(*) FILTER (status = 'done') / nullif(count(*) FILTER (status IN ('done', 'failed')), 0) AS success_rate FROM jobs WHERE {LOCAL.format('updated_at')} BETWEEN DATE '{R[0]}' AND DATE '{R[1]}' GROUP BY 1"
query("agg11_success_rate", _worst)(lambda s, d: G.success_rates(J(s, d), *R))
query("jn11_daily_merge", f"""SELECT coalesce(a.date, j.date) AS date, coalesce(a.n, 0) AS articles, coalesce(j.n, 0) AS fetch_failed FROM (SELECT {DAY.format('created_at')} AS date, count(*) AS n FROM articles WHERE {IN_A} GROUP BY 1) a
FULL JOIN (SELECT {DAY.format('updated_at')} AS date, count(*) AS n FROM jobs WHERE {IN_J} GROUP BY 1) j ON a.date = j.date""")(lambda s, d: G.daily_table(A(s, d), J(s, d), *R))

# Health
query("agg12_source_counters", f"""SELECT count(*) AS total, count(*) FILTER (is_enabled) AS enabled, count(*) FILTER (is_enabled AND (next_run_at IS NULL OR next_run_at <= {AS_OF_SQL})) AS due,
count(*) FILTER (is_enabled AND consecutive_failures > 0) AS failing, count(*) FILTER (is_enabled AND consecutive_failures > 0 AND next_run_at > {AS_OF_SQL}) AS backed_off FROM sources""")(lambda s, d: G.source_counters(S(s, d), as_of()))
_st = lambda col, vs: ", ".join(f"count(*) FILTER ({col} = '{v}') AS {v}" for v in vs)
query("agg13_article_counters", f"SELECT count(*) AS total, {_st('summary_status', ('pending', 'processing', 'done', 'failed', 'skipped'))}, count(*) FILTER (summary_status = 'failed' AND retry_count < 3) AS retryable_failed FROM articles")(lambda s, d: G.article_counters(A(s, d)))
query("agg14_job_counters", f"SELECT count(*) AS total, {_st('status', ('discovered', 'fetching', 'done', 'failed', 'skipped'))}, count(*) FILTER (status = 'failed' AND retry_count < 3) AS retryable_failed, epoch({AS_OF_SQL} - min(created_at) FILTER (status = 'discovered')) / 60.0::DOUBLE AS oldest_discovered_minutes FROM jobs")(
    lambda s, d: G.job_counters(J(s, d), as_of())
)
query("agg15_forum_totals", f"""SELECT json_extract_string(metadata, '$.forum.kind') AS kind, sum((metadata->>'$.forum.threadsSeen')::INT)::BIGINT AS threads_seen, sum((metadata->>'$.forum.inserted')::INT)::BIGINT AS inserted,
sum((metadata->>'$.forum.fetchErrors')::INT)::BIGINT AS fetch_errors FROM logs WHERE json_extract(metadata, '$.forum') IS NOT NULL AND started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1""")(lambda s, d: G.forum_totals(L(s, d), as_of()))
query("agg15_forum_recent", "SELECT l.id, l.source_id, s.name AS source_name, l.status, l.items_found, json_extract_string(metadata, '$.forum.kind') AS kind FROM logs l LEFT JOIN sources s ON s.id = l.source_id WHERE json_extract(metadata, '$.forum') IS NOT NULL ORDER BY started_at DESC, l.id DESC LIMIT 8")(
    lambda s, d: G.forum_recent(L(s, d), S(s, d))
)
_d, _w = f"started_at >= {AS_OF_SQL} - INTERVAL 24 HOUR", f"started_at >= {AS_OF_SQL} - INTERVAL 7 DAY"
_quality = f"""SELECT s.id, s.name, CASE WHEN NOT is_enabled THEN 'disabled' WHEN consecutive_failures > 0 THEN 'failing' WHEN last_success_at IS NULL OR epoch({AS_OF_SQL} - last_success_at) > 259200 THEN 'stale'
WHEN coalesce(runs_24h, 0) >= 2 AND coalesce(found_24h, 0) > 0 AND coalesce(inserted_24h, 0) = 0 THEN 'low_yield' ELSE 'healthy' END AS status, coalesce(runs_24h, 0) AS runs_24h, coalesce(found_24h, 0) AS found_24h, coalesce(inserted_24h, 0) AS inserted_24h,
coalesce(failed_24h, 0) AS failed_24h, coalesce(runs_7d, 0) AS runs_7d, coalesce(found_7d, 0) AS found_7d, coalesce(inserted_7d, 0) AS inserted_7d, coalesce(failed_7d, 0) AS failed_7d,
CASE WHEN found_24h > 0 THEN inserted_24h / found_24h END AS insert_rate_24h, CASE WHEN found_7d > 0 THEN inserted_7d / found_7d END AS insert_rate_7d
FROM sources s LEFT JOIN (SELECT source_id, count(*) FILTER ({_d}) AS runs_24h, (sum(items_found) FILTER ({_d}))::BIGINT AS found_24h, (sum(items_inserted) FILTER ({_d}))::BIGINT AS inserted_24h, count(*) FILTER ({_d} AND status = 'failed') AS failed_24h,
count(*) AS runs_7d, sum(items_found)::BIGINT AS found_7d, sum(items_inserted)::BIGINT AS inserted_7d, count(*) FILTER (status = 'failed') AS failed_7d FROM logs WHERE {_w} GROUP BY 1) l ON l.source_id = s.id"""
query("agg16_source_quality", _quality)(lambda s, d: G.source_quality(S(s, d), L(s, d), as_of()))
query("jn16_sources_logs", "SELECT s.id, s.name, count(l.id) AS runs, strftime(max(l.started_at), '%Y-%m-%d %H:%M:%S') AS last_run FROM sources s LEFT JOIN logs l ON l.source_id = s.id GROUP BY 1, 2")(
    lambda s, d: G.with_runs(S(s, d), L(s, d)).select("id", "name", "runs", ts("last_run"))
)
query("agg16_quality_summary", f"SELECT k.status, count(q.id) AS n FROM (VALUES ('healthy'), ('low_yield'), ('failing'), ('stale'), ('disabled')) k(status) LEFT JOIN ({_quality}) q ON q.status = k.status GROUP BY 1")(
    lambda s, d: G.quality_summary(G.source_quality(S(s, d), L(s, d), as_of()))
)
query("agg17_top_fetch_errors", f"SELECT coalesce(error_type, 'unknown') AS error_type, coalesce(last_http_status::VARCHAR, '') AS http_status, count(*) AS n, {TS.format('max(updated_at)')} AS last_seen FROM jobs WHERE status = 'failed' AND updated_at > {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1, 2 ORDER BY n DESC, last_seen DESC, 1, 2 LIMIT 10")(
    lambda s, d: G.top_fetch_errors(J(s, d), as_of())
)
query("agg18_top_summary_errors", f"SELECT substr(coalesce(last_summary_error, 'unknown'), 1, 160) AS error, count(*) AS n, {TS.format('max(updated_at)')} AS last_seen FROM articles WHERE summary_status = 'failed' AND updated_at > {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1 ORDER BY n DESC, last_seen DESC, 1 LIMIT 10")(
    lambda s, d: G.top_summary_errors(A(s, d), as_of())
)
_few = "(SELECT * REPLACE (CASE WHEN source_id IN ('src3', 'src7', 'src12') THEN 0 ELSE items_inserted END AS items_inserted) FROM logs)"
query("agg19_low_yield", f"SELECT s.id AS source_id, s.name, count(*) AS runs, sum(items_found)::BIGINT AS items_found, sum(items_inserted)::BIGINT AS items_inserted FROM sources s JOIN {_few} l ON l.source_id = s.id WHERE started_at > {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1, 2 HAVING sum(items_found) >= 20 AND sum(items_inserted) = 0 ORDER BY items_found DESC, 1 LIMIT 10")(
    lambda s, d: G.low_yield(S(s, d), L(s, d).withColumn("items_inserted", F.when(F.col("source_id").isin("src3", "src7", "src12"), 0).otherwise(F.col("items_inserted"))), as_of())
)
query("win05_failure_streaks", "SELECT source_id, count(*) FILTER (status = 'failed' AND (last IS NULL OR (started_at, id) > last)) AS failures FROM (SELECT *, max(CASE WHEN status <> 'failed' THEN (started_at, id) END) OVER (PARTITION BY source_id) AS last FROM logs) GROUP BY 1")(
    lambda s, d: G.failure_streaks(L(s, d))
)
query("win06_quota", "SELECT id, k, k < 4 AS allowed FROM (SELECT id, row_number() OVER (PARTITION BY source_id, started_at::DATE ORDER BY started_at, id) AS k FROM logs)")(
    lambda s, d: G.quota_admissions(L(s, d).select("id", F.col("source_id").alias("provider"), F.col("started_at").alias("ts")), 4).select("id", "k", "allowed")
)
query("agg30_counters", "SELECT source_id, count(*) FILTER (status <> 'failed') AS successes, count(*) FILTER (status = 'failed') AS failures, arg_max(error_message, (started_at, id)) FILTER (error_message IS NOT NULL) AS last_error FROM logs GROUP BY 1")(
    lambda s, d: L(s, d).groupBy("source_id").agg(F.count_if(F.col("status") != "failed").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"), F.max_by(F.col("error_message"), F.when(F.col("error_message").isNotNull(), F.struct("started_at", "id"))).alias("last_error"))
)
_sev = {"failed": 1, "retryable_failed": 2, "fetching": 3, "discovered": 4}
query("agg28_work_board", "WITH m AS (SELECT count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed' AND retry_count < 3) AS retryable_failed, count(*) FILTER (status = 'fetching') AS fetching, count(*) FILTER (status = 'discovered') AS discovered FROM jobs) SELECT item, n, severity FROM (SELECT 'failed' AS item, failed AS n, 1 AS severity FROM m UNION ALL SELECT 'retryable_failed', retryable_failed, 2 FROM m UNION ALL SELECT 'fetching', fetching, 3 FROM m UNION ALL SELECT 'discovered', discovered, 4 FROM m) WHERE n > 0")(
    lambda s, d: G.work_board(G.job_counters(J(s, d), as_of()).select(*_sev), _sev)
)

# Visits
query("src24_access_log", "SELECT ip, strftime(date, '%Y-%m-%d') AS date, method, path, status, is_bot FROM visits")(lambda s, d: V(s, d).select("ip", F.date_format("date", "yyyy-MM-dd").alias("date"), "method", "path", "status", "is_bot"))
query("agg22_visits_by_day", "SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (NOT is_bot) AS humans, count(DISTINCT ip) FILTER (NOT is_bot) AS unique_ips FROM visits GROUP BY 1")(
    lambda s, d: G.visits_by_day(V(s, d)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
)
query("agg23_top_ips", "SELECT ip, count(*) AS total, count(*) FILTER (NOT is_bot) AS humans, count(*) FILTER (is_bot) AS bots, least(count(DISTINCT path), 50) AS paths FROM visits GROUP BY 1 ORDER BY total DESC, ip LIMIT 30")(lambda s, d: G.top_ips(V(s, d)))
query("agg24_visit_totals", "SELECT count(*) AS total, count(*) FILTER (NOT is_bot) AS humans, count(*) FILTER (is_bot) AS bots, count(DISTINCT ip) FILTER (NOT is_bot) AS unique_ips FROM visits")(lambda s, d: G.visit_totals(V(s, d)))

# State transitions: the rows of the next snapshot.
JC = ["id", "status", "retry_count", "last_error", "skip_reason", "error_type", "last_http_status"]


def jobs_out(df):
    return df.select(*JC, ts("updated_at"))


def jobs_sql(rows: str) -> str:
    return f"SELECT {', '.join(JC)}, {TS.format('updated_at')} AS updated_at FROM ({rows})"


def changed(where: str, values: dict[str, str], table: str = "jobs") -> str:
    sets = ", ".join(f"CASE WHEN {where} THEN {v} ELSE {c} END AS {c}" for c, v in {**values, "updated_at": AS_OF_SQL}.items())
    return f"SELECT * REPLACE ({sets}) FROM {table}"


CLEAR = {"error_type": "NULL", "last_http_status": "NULL"}
_pick = "id IN (SELECT id FROM jobs WHERE status = 'discovered' ORDER BY created_at DESC, id DESC LIMIT 30)"
query("st01_claim_jobs", jobs_sql(changed(_pick, {"status": "'fetching'", "last_error": "NULL"})))(lambda s, d: jobs_out(ST.claim_jobs(J(s, d), as_of())))
_from = lambda s, d: L(s, d).groupBy("source_id").agg(F.max_by("error_message", F.struct("started_at", "id")).alias("seen")).where("seen is not null")
query("jn15_update_from", "SELECT j.id, CASE WHEN e.seen IS NOT NULL AND j.status = 'failed' THEN e.seen ELSE j.last_error END AS last_error, j.status FROM jobs j LEFT JOIN (SELECT source_id, arg_max_null(error_message, (started_at, id)) AS seen FROM logs GROUP BY 1) e ON e.source_id = j.source_id")(
    lambda s, d: M.merge(J(s, d).select("source_id", "id", "status", "last_error"), _from(s, d), ["source_id"], {"last_error": F.col("c.seen")}, insert=False, when=F.col("t.status") == "failed").select("id", "last_error", "status")
)
query("jn03_claimed_sources", f"SELECT j.id, j.source_id, s.name AS source_name, s.type AS source_type FROM (SELECT * FROM jobs WHERE {_pick}) j JOIN sources s ON s.id = j.source_id")(
    lambda s, d: ST.claimed_with_sources(J(s, d), S(s, d)).select("id", "source_id", "source_name", "source_type")
)
AC = ["id", "summary_status", "retry_count", "last_summary_error"]


def articles_out(df):
    return df.select(*AC, ts("updated_at"))


def articles_sql(rows: str) -> str:
    return f"SELECT {', '.join(AC)}, {TS.format('updated_at')} AS updated_at FROM ({rows})"


query("st01_claim_summaries", articles_sql(changed("id IN (SELECT id FROM articles WHERE summary_status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 30)", {"summary_status": "'processing'"}, "articles")))(
    lambda s, d: articles_out(ST.claim_summaries(A(s, d), as_of()))
)
query("st02_expire", jobs_sql(changed(f"status = 'discovered' AND created_at < {AS_OF_SQL} - INTERVAL 12 HOUR AND coalesce(payload_json->>'$.rescueArticleId', '') = '' AND coalesce(payload_json->>'$.isManualSave', 'false') <> 'true'", {"status": "'skipped'", "skip_reason": f"'{ST.STALE_REASON}'", "last_error": "NULL", **CLEAR})))(
    lambda s, d: jobs_out(ST.expire_jobs(J(s, d), as_of()))
)
query("st03_unstick_jobs", jobs_sql(changed(f"status = 'fetching' AND updated_at < {AS_OF_SQL} - INTERVAL 10 MINUTE", {"status": "'discovered'", "last_error": "'Reset stale fetching state'", "skip_reason": "NULL", **CLEAR})))(lambda s, d: jobs_out(ST.unstick_jobs(J(s, d), as_of())))
query("st03_unstick_summaries", articles_sql(changed(f"summary_status = 'processing' AND updated_at < {AS_OF_SQL} - INTERVAL 10 MINUTE", {"summary_status": "'pending'", "last_summary_error": "'Reset stale processing state'"}, "articles")))(
    lambda s, d: articles_out(ST.unstick_summaries(A(s, d), as_of()))
)
_retry = f"id IN (SELECT id FROM jobs WHERE status = 'failed' AND retry_count < 3 AND (next_attempt_at IS NULL OR next_attempt_at <= {AS_OF_SQL}) AND coalesce(error_type, 'unknown') NOT IN ('not_found', 'invalid_url') AND updated_at < {AS_OF_SQL} - INTERVAL 10 MINUTE ORDER BY updated_at, id LIMIT 15)"
query("st04_retry_jobs", jobs_sql(changed(_retry, {"status": "'discovered'", "skip_reason": "NULL", **CLEAR})))(lambda s, d: jobs_out(ST.retry_jobs(J(s, d), as_of())))
_pat = " OR ".join(f"contains(lower(coalesce(last_summary_error, '')), '{p}')" for p in C.RETRYABLE)
query("st04_retry_summaries", articles_sql(changed(f"id IN (SELECT id FROM articles WHERE summary_status = 'failed' AND retry_count < 3 AND ({_pat}) AND updated_at < {AS_OF_SQL} - INTERVAL 10 MINUTE ORDER BY updated_at, id LIMIT 15)", {"summary_status": "'pending'"}, "articles")))(
    lambda s, d: articles_out(ST.retry_summaries(A(s, d), as_of()))
)
_err = "CASE id % 3 WHEN 0 THEN 'HTTP 503 upstream' WHEN 1 THEN 'HTTP 404 gone' ELSE 'Cloudflare challenge' END"


def _outcomes(s, d):
    i = F.col("id")
    rows = J(s, d).where("status = 'fetching' and id % 2 = 0")
    return rows.select("id", F.when(i % 6 == 0, "done").when(i % 6 == 2, "failed").otherwise("skipped").alias("outcome"), F.when(i % 6 != 0, F.expr(_err)).alias("error"))


query("st05_job_outcomes", jobs_sql(f"""SELECT j.* REPLACE (CASE WHEN h THEN o ELSE status END AS status, CASE WHEN h AND o = 'failed' THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN h THEN CASE WHEN o = 'failed' THEN e END ELSE last_error END AS last_error,
CASE WHEN h THEN CASE WHEN o = 'failed' THEN CASE id % 3 WHEN 0 THEN 'server_error' WHEN 1 THEN 'not_found' ELSE 'blocked' END END ELSE error_type END AS error_type,
CASE WHEN h THEN CASE WHEN o = 'failed' THEN CASE id % 3 WHEN 0 THEN 503 WHEN 1 THEN 404 END END ELSE last_http_status END AS last_http_status, CASE WHEN h THEN CASE WHEN o = 'skipped' THEN e END ELSE skip_reason END AS skip_reason, CASE WHEN h THEN {AS_OF_SQL} ELSE updated_at END AS updated_at)
FROM (SELECT *, status = 'fetching' AND id % 2 = 0 AS h, CASE id % 6 WHEN 0 THEN 'done' WHEN 2 THEN 'failed' ELSE 'skipped' END AS o, {_err} AS e FROM jobs) j"""))(lambda s, d: jobs_out(ST.job_outcomes(J(s, d), _outcomes(s, d), as_of())))
query("jn05_not_exists", "SELECT s.id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source_id = s.id AND j.status = 'failed' AND j.error_type = 'not_found')")(
    lambda s, d: S(s, d).join(J(s, d).where("status = 'failed' and error_type = 'not_found'").select(F.col("source_id").alias("id")), "id", "left_anti").select("id")
)
query("st06_short_content", """SELECT a.id, a.source_id, a.url, a.title FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.summary_status = 'skipped' AND a.last_summary_error ILIKE '%source content too short%' AND greatest(length(a.raw_content), length(a.raw_excerpt)) < 500
    AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.source_id = a.source_id AND j.url = a.url AND coalesce(j.payload_json->>'$.rescueArticleId', '') = a.id::VARCHAR) AND s.type IN ('rss', 'web') ORDER BY a.created_at DESC, a.id DESC LIMIT 30""")(lambda s, d: ST.short_content(A(s, d), J(s, d), S(s, d)))
_again = lambda s, d: J(s, d).where("id % 4 = 0").select("source_id", "url", "title", F.lit('{"isManualSave": true}').alias("payload_json"))
query("snk03_requeue", f"SELECT id, CASE WHEN h THEN 'discovered' ELSE status END AS status, CASE WHEN h THEN 0 ELSE retry_count END AS retry_count, CASE WHEN h THEN NULL ELSE last_error END AS last_error, {TS.format(f'CASE WHEN h THEN {AS_OF_SQL} ELSE updated_at END')} AS updated_at FROM (SELECT *, id % 4 = 0 AND status IN ('done', 'skipped') AS h FROM jobs)")(
    lambda s, d: ST.requeue(J(s, d), _again(s, d), as_of()).select("id", "status", "retry_count", "last_error", ts("updated_at"))
)
query("st07_apply_rescue", f"SELECT id, CASE WHEN h THEN 'pending' ELSE summary_status END AS summary_status, CASE WHEN h THEN NULL ELSE tldr END AS tldr, CASE WHEN h THEN 'new ' || id ELSE substr(raw_content, 1, 30) END AS head FROM (SELECT *, id % 10 = 9 AS h FROM articles)")(
    lambda s, d: ST.apply_rescue(A(s, d), A(s, d).where("id % 10 = 9").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("raw_content")), as_of()).select("id", "summary_status", "tldr", F.substring("raw_content", 1, 30).alias("head"))
)
_so = lambda s, d: A(s, d).where("summary_status = 'processing'").select("id", F.when(F.col("id") % 100 == 27, "done").otherwise("failed").alias("outcome"), F.lit("Short.").alias("tldr"), F.when(F.col("id") % 100 != 27, "timeout").alias("error"))
query("st08_summary_outcomes", f"SELECT id, CASE WHEN h THEN CASE WHEN id % 100 = 27 THEN 'done' ELSE 'failed' END ELSE summary_status END AS summary_status, CASE WHEN h AND id % 100 = 27 THEN 'Short.' ELSE tldr END AS tldr, CASE WHEN h AND id % 100 <> 27 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM (SELECT *, summary_status = 'processing' AS h FROM articles)")(
    lambda s, d: ST.summary_outcomes(A(s, d), _so(s, d), as_of()).select("id", "summary_status", "tldr", "retry_count")
)
_runs = lambda s, d: S(s, d).select("id", (F.length("id") % 2 == 0).alias("threw"), (F.col("consecutive_failures") % 2).cast("int").alias("n_errors"))
for _name, _manual in (("st09_source_runs", False), ("st09_manual_runs", True)):
    _bad = "(length(id) % 2 = 0" + (" OR consecutive_failures % 2 > 0)" if _manual else ")")
    query(_name, f"""SELECT id, CASE WHEN {_bad} THEN consecutive_failures + 1 ELSE 0 END::INT AS consecutive_failures,
    strftime({AS_OF_SQL} + to_minutes(CASE WHEN {_bad} THEN least(greatest(5, CASE WHEN fetch_interval_minutes > 0 THEN fetch_interval_minutes ELSE 60 END) * (2 ** consecutive_failures), 1440)::INT
    WHEN consecutive_failures % 2 > 0 THEN least(greatest(5, CASE WHEN fetch_interval_minutes > 0 THEN fetch_interval_minutes ELSE 60 END) * 2, 1440) ELSE greatest(5, CASE WHEN fetch_interval_minutes > 0 THEN fetch_interval_minutes ELSE 60 END) END), '%Y-%m-%d %H:%M:%S') AS next_run_at FROM sources""")(
        lambda s, d, m=_manual: ST.source_outcomes(S(s, d), _runs(s, d), as_of(), m).select("id", "consecutive_failures", ts("next_run_at"))
    )
query("st10_due_sources", f"SELECT id, name, consecutive_failures FROM sources WHERE is_enabled AND (next_run_at IS NULL OR next_run_at <= {AS_OF_SQL})")(lambda s, d: ST.due_sources(S(s, d), as_of()).select("id", "name", "consecutive_failures"))
query("st11_retention", f"SELECT 'log' AS kind, id FROM logs WHERE started_at >= {AS_OF_SQL} - INTERVAL 14 DAY UNION ALL SELECT 'text', id FROM articles WHERE created_at >= {AS_OF_SQL} - INTERVAL 20 DAY")(
    lambda s, d: ST.retain_logs(L(s, d), as_of()).select(F.lit("log").alias("kind"), "id").unionByName(ST.retain_content(A(s, d), as_of(), 20).where("raw_content is not null").select(F.lit("text").alias("kind"), "id"))
)
_forum = lambda s, d: O.with_sources(A(s, d).withColumn("created_at", F.timestamp_seconds(F.unix_timestamp(as_of()) - F.col("id") * 7 % 600 * 60)), S(s, d))
query("st12_refresh", f"SELECT a.id FROM (SELECT * REPLACE ({AS_OF_SQL} - to_minutes(id * 7 % 600) AS created_at) FROM articles) a LEFT JOIN sources s ON s.id = a.source_id WHERE regexp_matches(a.url || ' ' || coalesce(s.name, ''), '(?i)voz|reddit') AND a.created_at BETWEEN {AS_OF_SQL} - INTERVAL 4 HOUR AND {AS_OF_SQL} AND a.rescraped_count < 2 ORDER BY a.created_at DESC, a.id DESC LIMIT 30")(
    lambda s, d: ST.refresh_candidates(_forum(s, d), C.is_forum_article(F.col("url"), F.col("source_name"), F.col("title")), as_of()).select("id")
)
query("st13_empty_threads", f"SELECT id FROM articles WHERE contains(raw_content, 'the') AND created_at >= {AS_OF_SQL} - INTERVAL 48 HOUR ORDER BY created_at DESC, id DESC LIMIT 10")(lambda s, d: ST.empty_threads(A(s, d), as_of(), "the").select("id"))
query("st14_save", "SELECT id, CASE WHEN id % 8 = 0 THEN NOT is_saved ELSE is_saved END AS is_saved FROM articles")(
    lambda s, d: ST.set_saved(A(s, d), A(s, d).where("id % 8 = 0").select("id", (~F.col("is_saved")).alias("is_saved")), as_of()).select("id", "is_saved")
)

# Sinks
_new = lambda s, d: A(s, d).where("id % 2 = 0").select("id", "url", F.sha2(F.lower(F.trim("raw_content")).cast("binary"), 256).alias("hash"), "created_at")
query("snk01_insert_absent", "WITH h AS (SELECT id, url, sha256(lower(trim(raw_content))) AS hash FROM articles) SELECT id FROM h WHERE id % 3 = 0 UNION ALL SELECT min(id) FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE id % 3 = 0) GROUP BY hash")(
    lambda s, d: (lambda h: M.insert_absent(h.where("id % 3 = 0"), h.where("id % 3 <> 0"), ["hash"], [F.col("id")]).select("id"))(A(s, d).select("id", F.sha2(F.lower(F.trim("raw_content")).cast("binary"), 256).alias("hash")))
)
query("agg20_dedupe", "WITH h AS (SELECT id, url, sha256(lower(trim(raw_content))) AS hash, created_at FROM articles) SELECT id FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY created_at, id) = 1")(
    lambda s, d: M.keep_first(M.keep_first(A(s, d).select("id", "url", F.sha2(F.lower(F.trim("raw_content")).cast("binary"), 256).alias("hash"), "created_at"), ["url"], [F.col("created_at"), F.col("id")]), ["hash"], [F.col("created_at"), F.col("id")]).select("id")
)
query("snk02_enqueue_absent", "SELECT source_id, url FROM jobs UNION SELECT source_id, url FROM articles WHERE id % 5 = 0")(
    lambda s, d: M.insert_absent(J(s, d).select("source_id", "url"), A(s, d).where("id % 5 = 0").select("source_id", "url", "id"), ["source_id", "url"], [F.col("id")]).distinct()
)
query("snk04_upsert", "SELECT id AS key, CASE WHEN id LIKE '%1%' THEN 'new' ELSE name END AS value FROM sources UNION ALL SELECT 'extra', 'new'")(
    lambda s, d: M.merge(S(s, d).select(F.col("id").alias("key"), F.col("name").alias("value")), S(s, d).where("id like '%1%'").select(F.col("id").alias("key"), F.lit("new").alias("value")).unionByName(s.range(1).select(F.lit("extra").alias("key"), F.lit("new").alias("value"))), ["key"])
)
query("snk05_delete", "SELECT id, CASE WHEN parent_article_id % 12 = 0 THEN NULL ELSE parent_article_id END AS parent_article_id FROM articles WHERE id % 12 <> 0")(
    lambda s, d: M.delete_articles(A(s, d), A(s, d).select(F.col("id").alias("article_id")), A(s, d).where("id % 12 = 0").select("id"))[0].select("id", "parent_article_id")
)
query("snk05_cascade", "SELECT id FROM articles WHERE source_id NOT IN ('src1', 'src4')")(lambda s, d: M.delete_sources(S(s, d), A(s, d), S(s, d).where("id in ('src1', 'src4')"))[1].select("id"))
query("snk06_sitemap", "SELECT '<url><loc>' || url || '</loc><lastmod>' || strftime(coalesce(updated_at, published_at, created_at), '%Y-%m-%d') || '</lastmod></url>' AS value FROM articles WHERE summary_status = 'done' AND parent_article_id IS NULL ORDER BY coalesce(published_at, created_at) DESC, id DESC LIMIT 1000")(
    lambda s, d: A(s, d).where("summary_status = 'done' and parent_article_id is null").orderBy(F.coalesce("published_at", "created_at").desc(), F.col("id").desc()).limit(1000).select(
        F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"), F.date_format(F.coalesce("updated_at", "published_at", "created_at"), "yyyy-MM-dd"), F.lit("</lastmod></url>")).alias("value")
    )
)
query("snk07_run_log", "SELECT id, CASE WHEN items_found % 3 = 0 THEN 'success' WHEN items_inserted > 0 THEN 'partial' ELSE 'failed' END AS status FROM logs")(
    lambda s, d: M.run_log(L(s, d).withColumn("errors", F.col("items_found") % 3)).select("id", "status")
)
query("win01_first_per_source", "SELECT id FROM articles QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) <= 20")(lambda s, d: M.first_per(A(s, d), "source_id", [F.col("id")], 20).select("id"))
query("agg21_keep_first", "SELECT min(id) AS id FROM articles GROUP BY lower(trim(title))")(lambda s, d: M.keep_first(A(s, d).select("id", F.lower(F.trim("title")).alias("k")), ["k"], [F.col("id")]).select("id"))
