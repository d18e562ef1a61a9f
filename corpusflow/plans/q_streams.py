"""Streaming queries: the given tables as file streams, run to their end, results read back from the shared folder."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusflow.operators import seen as SN
from corpusflow.operators import sketches as SK
from corpusflow.plans import fixtures as X
from corpusflow.plans.q_text import _edges, near
from corpusflow.runtime import read, shared_folder
from corpusflow.sources.logs import parse_access_log
from corpusflow.streaming import jobs as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = X.with_tables(sql)
        return f

    return put


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table as a file stream (a glob, because the table may be one file)."""
    schema = read(spark, sf_dir, table).schema
    return ST.stream_table(spark, f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet", schema)


def finished(df: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """The stream run to its end; in complete mode the last result, in update mode the last row of each of the ``keys``, else all batches."""
    folder = _folder(df.sparkSession)
    out, spark, schema = f"{folder}/out", df.sparkSession, df.schema
    spark.createDataFrame([], schema).write.parquet(out if mode == "complete" else f"{out}/batch=-1")  # for streams without rows

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    ST.run_available(df, sink, f"{folder}/state", mode)
    found = spark.read.parquet(out)
    if mode != "update":
        return found.select(*df.columns)
    rest = [c for c in df.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")


def batches(df: DataFrame, step) -> DataFrame:
    """All results of ``step(batch, number, folder)`` over the batches of a stream that is run to its end."""
    folder = _folder(df.sparkSession)

    def sink(batch: DataFrame, number: int) -> None:
        step(batch, number, folder).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    ST.run_available(df, sink, f"{folder}/progress")
    return df.sparkSession.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def parts_in_order(df: DataFrame, by: str, parts: int = 4) -> DataFrame:
    """A table as a stream of ``parts`` batches, one after the other, of rising values of ``by``.

    The table is dealt into one folder a part by as many tasks as read it.  The stream
    itself holds the numbers of the parts, one file each, and is joined with the folders,
    so a batch is a whole part whatever its number of files.
    """
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    low, high = df.agg(F.min(by), F.max(by)).first()
    part = F.least(F.floor((F.col(by) - F.lit(low)) * parts / F.lit(max(1, (high or 0) - (low or 0) + 1))), F.lit(parts - 1))
    df.withColumn("__part", F.when(F.col(by).isNull(), 0).otherwise(part).cast("int")).write.partitionBy("__part").parquet(f"{folder}/parts")
    for i in range(parts):
        spark.range(i, i + 1, 1, 1).select(F.col("id").cast("int").alias("__part")).write.mode("append").parquet(f"{folder}/turns")
    table = spark.read.schema(StructType([*df.schema.fields, StructField("__part", IntegerType())])).parquet(f"{folder}/parts")
    turns = ST.stream_table(spark, f"{folder}/turns", StructType([StructField("__part", IntegerType())]))
    return table.join(F.broadcast(turns), "__part").select(*df.columns)  # one number a batch


def events(s, d) -> DataFrame:
    return stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def log_rows(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.date_trunc("second", "ts").alias("started_at"))


def in_order(s, d, rows_of) -> DataFrame:
    """Rows of the events as a stream of several batches in order of time."""
    e = read(s, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    rows = rows_of(e.withColumn("ts", F.col("ts").cast("timestamp")))
    return parts_in_order(rows.withColumn("at", F.unix_seconds("started_at")), "at")


@query("str01_store_new", "SELECT min(doc_id) AS id, count(*) AS n FROM documents GROUP BY lower(trim(text)) HAVING true")
def store_new(s, d):
    folder = _folder(s)
    state = {"path": None}

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("hash"), F.col("doc_id").alias("id"))
        new = rows.groupBy("hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        if state["path"]:
            new = s.read.parquet(state["path"]).unionByName(new).groupBy("hash").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
        state["path"] = f"{folder}/snapshot-{number}"
        new.write.mode("overwrite").parquet(state["path"])

    ST.run_available(stream(s, d, "documents"), sink, f"{folder}/state")
    return s.read.parquet(state["path"]).select("id", "n")


query("str02_first_seen", "SELECT DISTINCT user_id FROM events")(lambda s, d: finished(ST.first_seen(events(s, d), "user_id", "ts", "40 days")).select("user_id"))


def admitted(df: DataFrame, keys: list[str], order: str, expected: int) -> DataFrame:
    """What a stream of five batches adds to the keys seen before, without a watermark."""
    seen = _folder(df.sparkSession)
    return batches(parts_in_order(df, order, 5), lambda b, n, f: SN.admit_new(b, n, seen, keys, [order], expected, fan=4))


query("str02_seen_texts", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))")(
    lambda s, d: admitted(read(s, d, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("hash")), ["hash"], "doc_id", 1_000_000).select("doc_id")
)
query("str02_seen_pairs", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")(
    lambda s, d: admitted(read(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", 1_000_000).select("user_id", "event_type", "event_id")
)
query("str03_bounds", "SELECT event_id, strftime(least(date_trunc('second', ts), CASE WHEN ts > TIMESTAMP '2024-01-20 02:00:00' THEN TIMESTAMP '2024-01-20' ELSE date_trunc('second', ts) END), '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE least(ts, CASE WHEN ts > TIMESTAMP '2024-01-20 02:00:00' THEN TIMESTAMP '2024-01-20' ELSE ts END) >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR")(
    lambda s, d: finished(ST.within_bounds(events(s, d).select("event_id", "ts"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 72)).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
)
query("str04_daily_counts", "SELECT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s, d: finished(ST.daily_counts(events(s, d), "ts", ["event_type"]), "update", ("date", "event_type")))
query("str04_rolling_counts", "SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS h FROM events) GROUP BY 1")(
    lambda s, d: finished(ST.rolling_counts(events(s, d), "ts"), "update", ("until",)).select(F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"), "n")
)
@query("str05_source_state", "WITH l AS (SELECT 'src' || (user_id % 20) AS source_id, event_id AS id, event_type = 'error' AS failed, date_trunc('second', ts) AS t FROM events), m AS (SELECT *, max(CASE WHEN NOT failed THEN (t, id) END) OVER (PARTITION BY source_id) AS last FROM l) SELECT source_id, count(*) FILTER (failed AND (last IS NULL OR (t, id) > last))::INT AS failures FROM m GROUP BY 1")
def last_state(s, d):
    out = batches(in_order(s, d, log_rows), ST.source_state)
    return out.groupBy("source_id").agg(F.max_by("failures", "batch").cast("int").alias("failures"))


@query("str06_arrivals_clustered", _edges)
def arrivals(s, d):
    """Articles arrive in four batches; each is clustered within itself and with the stored six hours before it."""
    rows = near(s, d).select("id", "created_at", "image_url", "title", "raw_excerpt")
    out = ST.latest(batches(parts_in_order(rows, "id"), ST.cluster_arrivals)).where("best_id is not null")
    return out.select("id", "best_id", *[F.round(x, 6).alias(x) for x in ("title_score", "score", "novelty")], "accepted")


query("str07_admissions", "SELECT id, k::INT AS k, k < 4 AS allowed FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id % 20, ts::DATE ORDER BY date_trunc('second', ts), event_id) AS k FROM events)")(
    lambda s, d: batches(in_order(s, d, log_rows).select("id", F.col("source_id").alias("provider"), F.col("started_at").alias("ts")), lambda b, n, f: ST.admissions(b, n, f, 4)).transform(ST.latest)
)
query("str08_visits", "SELECT strftime(date, '%Y-%m-%d') AS date, count(*) FILTER (NOT is_bot) AS humans, count(*) FILTER (is_bot) AS bots FROM visits GROUP BY 1")(
    lambda s, d: finished(ST.visits_by_day(X.access_lines_of(events(s, d))), "complete").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "humans", "bots")
)


def sketched_visits(s, d) -> str:
    """Log lines in four batches, each stored as sketches of its days; the folder they are in."""
    folder = _folder(s)
    e = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lines = X.access_lines_of(parts_in_order(e, "event_id"))
    ST.run_available(lines, lambda b, n: SK.add_batch(parse_access_log(b), SK.VISITS, folder, n), f"{folder}/progress")
    return folder


query("str08_visit_sketches", "SELECT strftime(date, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (NOT is_bot) AS humans, count(*) FILTER (is_bot) AS bots, count(DISTINCT ip) FILTER (NOT is_bot) AS unique_ips FROM visits GROUP BY 1")(
    lambda s, d: SK.by_day(s, SK.VISITS, sketched_visits(s, d)).select(F.date_format("day", "yyyy-MM-dd").alias("date"), "total", "humans", "bots", "unique_ips")
)
query("agg24_range_sketches", "SELECT count(*) AS total, count(*) FILTER (NOT is_bot) AS humans, count(*) FILTER (is_bot) AS bots, count(DISTINCT ip) FILTER (NOT is_bot) AS unique_ips FROM visits WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")(
    lambda s, d: SK.over_range(s, SK.VISITS, sketched_visits(s, d), date(2024, 1, 5), date(2024, 1, 20))
)
query("win07_fixed_windows")(
    lambda s, d: ST.fixed_windows(X.logs(s, d).select("id", F.col("source_id").alias("key"), F.col("started_at").alias("ts")), 10)
)
