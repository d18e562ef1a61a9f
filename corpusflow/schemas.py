"""Schemas of the logical tables, as DDL text for ``spark.read.schema``."""

SOURCES = (
    "id string, type string, name string, url string, language string, category string, is_enabled boolean, fetch_interval_minutes int, "
    "parser_config string, last_checked_at timestamp, last_success_at timestamp, last_error_message string, consecutive_failures int, "
    "next_run_at timestamp, created_at timestamp, updated_at timestamp, feed_category string"
)
ARTICLES = (
    "id bigint, source_id string, external_id string, url string, title string, author string, published_at timestamp, content_type string, "
    "language string, raw_excerpt string, raw_content string, content_hash string, summary_text string, summary_status string, image_url string, "
    "metadata string, created_at timestamp, updated_at timestamp, tldr string, rescraped_count int, hot_score int, tags array<string>, "
    "summary_short string, retry_count int, last_summary_error string, translated_title string, parent_article_id bigint, "
    "cluster_signature string, is_saved boolean"
)
JOBS = (
    "id bigint, source_id string, url string, title string, external_id string, published_at timestamp, payload_json string, status string, "
    "retry_count int, last_error string, created_at timestamp, updated_at timestamp, skip_reason string, error_type string, "
    "last_http_status int, next_attempt_at timestamp"
)
LOGS = (
    "id bigint, source_id string, job_type string, status string, started_at timestamp, finished_at timestamp, items_found int, "
    "items_inserted int, ai_calls int, error_message string, metadata string"
)
BLOCKLIST = ("id bigint, pattern string, type string, reason string, is_enabled boolean, hit_count int, last_hit_at timestamp")

SUMMARY_STATUSES = ("pending", "processing", "done", "failed", "skipped")
JOB_STATUSES = ("discovered", "fetching", "done", "failed", "skipped")
