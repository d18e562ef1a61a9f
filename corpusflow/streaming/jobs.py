"""Structured Streaming forms of the pipeline; each has a batch twin with the same result."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from corpusflow.functions.dates import LOCAL_ZONE
from corpusflow.operators.cluster import WINDOW_HOURS, parent_edges
from corpusflow.operators.stats import quota_admissions
from corpusflow.runtime import materialize
from corpusflow.sources.logs import parse_access_log


def stream_table(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, batch by batch, into ``sink(batch, id)``; then stop."""
    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_seen(stream: DataFrame, key: str, ts: str, watermark: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def within_bounds(stream: DataFrame, ts: str, batch_time, max_age_hours: int, ahead_hours: int = 2) -> DataFrame:
    """Late rows dropped, rows too far ahead clamped to the batch time."""
    t = F.when(F.col(ts) > batch_time + F.expr(f"INTERVAL {ahead_hours} HOURS"), batch_time).otherwise(F.col(ts))
    return stream.withColumn(ts, t).where(F.col(ts) >= batch_time - F.expr(f"INTERVAL {max_age_hours} HOURS"))


def daily_counts(stream: DataFrame, ts: str, keys: list[str], watermark: str | None = "1 day") -> DataFrame:
    """Tumbling counts by local day (the zone is seven hours ahead)."""
    base = stream.withWatermark(ts, watermark) if watermark else stream
    out = base.groupBy(F.window(ts, "1 day", startTime="17 hours"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.date_format(F.from_utc_timestamp(F.col("window.start"), LOCAL_ZONE), "yyyy-MM-dd").alias("date"), *keys, "n")


def rolling_counts(stream: DataFrame, ts: str, watermark: str | None = "1 day") -> DataFrame:
    """Counts of the last 24 hours, every hour."""
    base = stream.withWatermark(ts, watermark) if watermark else stream
    return base.groupBy(F.window(ts, "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("until"), "n")


def visits_by_day(lines: DataFrame) -> DataFrame:
    """Humans, bots and about how many addresses a day, from log lines."""
    v = parse_access_log(lines)
    return v.groupBy("date").agg(F.count_if(~F.col("is_bot")).alias("humans"), F.count_if("is_bot").alias("bots"), F.approx_count_distinct(F.when(~F.col("is_bot"), F.col("ip"))).alias("unique_ips"))


def _stored_days(batch: DataFrame, day: Column, number: int, folder: str) -> DataFrame:
    """Store a batch by day under its number and give the rows of all batches so far, with ``day`` and ``batch``.

    A repeated run of a batch replaces it; readers that bound ``day`` read those folders only.
    """
    batch.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{folder}/stored/batch={number}")
    schema = StructType([*batch.schema.fields, StructField("day", DateType()), StructField("batch", IntegerType())])
    stored = batch.sparkSession.read.schema(schema).option("basePath", f"{folder}/stored").parquet(f"{folder}/stored")
    return stored.where(F.col("batch") <= number)


def latest(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of what the batches gave for each key, the rows of its last batch: corrections replace what came before."""
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("m")).select(key, "m.*")


def cluster_arrivals(batch: DataFrame, number: int, folder: str, is_forum: Column | None = None) -> DataFrame:
    """Parent edges of the rows of one batch, and those of stored rows that the batch changes; a null ``best_id`` takes an edge back.

    Rows may come late and mixed up.  A new row can only change the edges of rows of
    the six hours after it, so those are found anew, from the rows of the six hours
    before the first new one on; for rows in order of time that is the batch alone.
    Only days that these hours touch are read.  The ``latest`` edge of each row that
    has one is that of the whole table, whatever the order of the batches.
    """
    kept = batch.select("id", "created_at", "image_url", "title", "raw_excerpt", (F.lit(False) if is_forum is None else is_forum).alias("is_forum"))
    stored = _stored_days(kept, F.to_date("created_at"), number, folder)
    first, last = stored.where(F.col("batch") == number).agg(F.min("created_at"), F.max("created_at")).first()
    first, last = F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")  # null for an empty batch, which changes nothing
    since, upto = (t.cast("timestamp") for t in (first - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS"), last + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")))
    near = stored.where(F.col("day").between(F.to_date(since), F.to_date(upto)) & F.col("created_at").between(since, upto))
    edges = parent_edges(near.select(*kept.columns), F.col("is_forum"))
    return near.where(F.col("created_at") >= first).select("id").join(edges, "id", "left")


def _since_success(rows: DataFrame) -> DataFrame:
    """``source_id, new, reset``: failures after the last success, and whether there is one; partial aggregates, so no source's rows meet in one place."""
    failed, at = F.col("status") == "failed", F.struct("started_at", "id")
    success = rows.where(~failed).groupBy("source_id").agg(F.max(at).alias("success"))
    after = F.col("success").isNull() | (at > F.col("success"))
    return rows.join(success, "source_id", "left").groupBy("source_id").agg(F.count_if(failed & after).alias("new"), F.max(F.col("success").isNotNull()).alias("reset"))


def _carried_on(before: DataFrame, sums: DataFrame) -> DataFrame:
    """``source_id, failures`` of a state followed by rows summed up by ``_since_success``."""
    kept = F.when(F.coalesce("reset", F.lit(False)), 0).otherwise(F.coalesce("failures", F.lit(0)))
    return before.join(sums, "source_id", "full_outer").select("source_id", (kept + F.coalesce("new", F.lit(0))).cast("long").alias("failures"))


def source_state(batch: DataFrame, number: int, folder: str, interval_minutes: int = 60, late_minutes: int = 60) -> DataFrame:
    """``source_id, failures, next_minutes`` of every source after a batch of its log rows: the failures since its last success.

    Rows may come up to ``late_minutes`` behind the latest one seen, in any order.
    The state is one row a source, for all rows older than that, plus the rows that
    are not: those that grow too old are folded into the former, the rest is summed
    up anew with each batch, so a late success takes failures back.  Rows that come
    later than allowed are left out.  A repeated run of a batch changes nothing.
    """
    spark = batch.sparkSession
    kept = batch.select("source_id", "id", "status", "started_at")
    mark = None  # rows before this time are settled
    if number:
        old = spark.read.parquet(f"{folder}/recent/batch={number - 1}")
        settled = spark.read.parquet(f"{folder}/settled/batch={number - 1}")
        mark = spark.read.parquet(f"{folder}/mark/batch={number - 1}").first()["t"]
        rows = old.unionByName(kept if mark is None else kept.where(F.col("started_at") >= F.lit(mark)))
    else:
        rows, settled = kept, spark.createDataFrame([], f"source_id {kept.schema['source_id'].dataType.simpleString()}, failures long")
    rows = materialize(rows)
    newest = rows.agg(F.max("started_at").alias("t") - F.expr(f"INTERVAL {late_minutes} MINUTES")).first()[0]
    mark = max((t for t in (mark, newest) if t is not None), default=None)
    past = F.lit(False) if mark is None else F.col("started_at") < F.lit(mark)
    _carried_on(settled, _since_success(rows.where(past))).write.mode("overwrite").parquet(f"{folder}/settled/batch={number}")
    rows.where(~past | F.col("started_at").isNull()).write.mode("overwrite").parquet(f"{folder}/recent/batch={number}")
    spark.createDataFrame([(mark,)], "t timestamp").write.mode("overwrite").parquet(f"{folder}/mark/batch={number}")
    settled, recent = spark.read.parquet(f"{folder}/settled/batch={number}"), spark.read.parquet(f"{folder}/recent/batch={number}")
    backoff = F.least(F.lit(interval_minutes) * F.pow(F.lit(2), F.col("failures") - 1), F.lit(1440))
    out = _carried_on(settled, _since_success(recent))
    return out.withColumn("next_minutes", F.when(F.col("failures") > 0, backoff).otherwise(interval_minutes).cast("int"))


def admissions(batch: DataFrame, number: int, folder: str, cap: int, key: str = "provider", ts: str = "ts") -> DataFrame:
    """``id, k, allowed`` of a batch of calls, and of stored calls that the batch pushes back: the k-th of a key and day is allowed if k < cap.

    Calls may come late and mixed up; the ``latest`` place of each is that of the
    whole table.  Calls are stored by day and only the days of the batch are read.
    Of a key and day, stored calls before the first new one are counted; only those
    after it are ranked again with the new ones (``quota_admissions``, no group
    meets in one place).
    """
    rows = batch.select("id", F.col(key).alias("key"), F.col(ts).alias("ts"))
    stored = _stored_days(rows, F.to_date("ts"), number, folder)
    at = F.struct("ts", "id")
    new = stored.where(F.col("batch") == number)
    first = materialize(new.groupBy(F.col("key").alias("__key"), F.col("day").alias("__day")).agg(F.min(at).alias("first")))
    low, high = first.agg(F.min("__day"), F.max("__day")).first()  # the days of the batch: folders to read
    days = F.col("day").between(F.lit(low), F.lit(high)) | (F.col("day").isNull() if not first.where("__day is null").isEmpty() else F.lit(False))
    touched = stored.where((F.col("batch") < number) & days).join(first, F.col("key").eqNullSafe(F.col("__key")) & F.col("day").eqNullSafe(F.col("__day")))
    used = touched.where(at < F.col("first")).groupBy("__key", "__day").agg(F.count(F.lit(1)).alias("used"))
    again = touched.where(at > F.col("first")).select("id", "key", "ts").unionByName(new.select("id", "key", "ts"))
    ranked = materialize(quota_admissions(again, cap, "key").withColumn("day", F.to_date("ts")))
    ranked = ranked.join(used, F.col("key").eqNullSafe(F.col("__key")) & F.col("day").eqNullSafe(F.col("__day")), "left")
    k = F.col("k") + F.coalesce("used", F.lit(0))
    return ranked.select("id", k.cast("int").alias("k"), (k < cap).alias("allowed"))


def _runs(names: pa.Array, slices: np.ndarray) -> np.ndarray:
    """Where the rows of another key or slice begin, in rows sorted by both."""
    codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])]) if len(slices) else np.zeros(0, np.int64)


def _steps(within: np.ndarray, begins: np.ndarray, width: int, span: int) -> np.ndarray:
    """For each row the first row of its run at least ``width`` after it, else the end of the run; times count from the start of the slice."""
    run = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(within)]))
    line = run * (span + 2 * width) + within  # runs one after the other, too far apart to meet
    return np.searchsorted(line, line + width, side="left")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut anew, so that no run of a key and slice is split."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        edge = pa.concat_tables([*(h.slice(h.num_rows - 1) for h in held[-1:]), table]).select(["name", "slice"]).combine_chunks()
        begins = _runs(edge["name"].combine_chunks(), edge["slice"].to_numpy())
        cut = int(begins[-1]) - (1 if held else 0)  # 0: the whole batch is one run of its own; below 0: it carries the held one on
        if cut >= 0 and (held or cut):
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
        held.append(table.slice(max(cut, 0)))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def fixed_windows(rows: DataFrame, limit: int, seconds: int = 60, slice_seconds: int = 3600) -> DataFrame:
    """``id, allowed``: requests in windows that start at a key's first hit, ``limit`` a window.

    A window's start depends on the one before.  Each key is cut into time slices:
    a slice first tells, for every row that could start its first window, where its
    last window would start and how many rows that would hold; these few facts are
    chained over the slices of a key; then each slice is counted from the window it
    is entered with.  All three are passes over sorted rows, whatever the number of
    keys and slices; a task holds the times of one slice, a batch of rows or the
    facts of one slice at once.  Rows of equal time are ordered by id; a null key is
    a key of its own; rows with a null time are refused.
    """
    width, span = seconds * 1_000_000, slice_seconds * 1_000_000
    name = F.col("key").cast("string").alias("name")
    timed = rows.where("ts is not null").select("id", name, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    timed = timed.withColumn("slice", F.expr(f"(t - pmod(t, {span}L)) div {span}L"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            names, slices, times = table["name"].combine_chunks(), table["slice"].to_numpy(), table["t"].to_numpy()
            begins, n = _runs(names, slices), len(times)
            sizes = np.diff(np.r_[begins, n])
            ends = np.repeat(begins + sizes, sizes)
            step, row = _steps(times - slices * span, begins, width, span), np.arange(n)
            last = np.where(step < ends, step, row)
            while not np.array_equal(last, last[last]):
                last = last[last]
            late = times - slices * span >= width
            head = ~late | np.r_[True, ~late[:-1]] | np.isin(row, begins)  # one of these starts the first window, unless all rows belong to the one before
            heads = np.flatnonzero(head)
            heads = heads[np.r_[(last[heads][1:] != last[heads][:-1]), True]]  # the last one of those with the same end tells for all
            offsets = pa.array(np.searchsorted(heads, np.r_[begins, n]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (times[heads], times[last[heads]], (ends - last)[heads])]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(begins)), pa.array(slices[begins]), pa.array(sizes), *lists], ["name", "slice", "n", "heads", "starts", "counts"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, held = object(), None, 0
        for batch in batches:
            out = []
            for of, n, heads, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "heads", "starts", "counts")), strict=True):
                if of != key:
                    key, start, held = of, None, 0
                out.append((start, held))
                at = 0 if start is None else bisect_left(heads, start + width)
                if at < len(heads):
                    start, held = starts[at], counts[at]
                else:
                    held += n
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("slice"), pa.array([s for s, _ in out], pa.int64()), pa.array([h for _, h in out], pa.int64())], ["name", "slice", "start", "held"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held = None, 0  # the window that the next row meets
        for batch in batches:
            enters = batch.column("t").is_null().to_numpy(zero_copy_only=False)  # such a row comes first in each slice and tells its start
            slices, times = batch.column("slice").to_numpy(), batch.column("t").fill_null(0).to_numpy()
            marks = np.flatnonzero(enters)
            pieces = [(-1, start, held), *zip(marks.tolist(), batch.column("start").take(pa.array(marks)).to_pylist(), batch.column("held").take(pa.array(marks)).to_pylist(), strict=True)]
            begins = np.unique(np.r_[0, marks]) if len(times) else marks
            step = _steps(np.where(enters, -width, times - slices * span), begins, width, span).tolist() if len(times) else []
            first, before = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64)
            for (mark, start, held), upto in zip(pieces, [*(m for m, _, _ in pieces[1:]), len(times)], strict=True):
                low = at = mark + 1
                if start is not None:
                    at = low + int(np.searchsorted(times[low:upto], start + width, side="left"))
                first[low:at], before[low:at] = low, held
                if at == upto:
                    held += upto - low
                while at < upto:
                    end = step[at]
                    first[at:end] = at
                    start, held, at = int(times[at]), end - at, end
            place = np.arange(len(times)) - first + before + 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(place <= limit)], ["id", "allowed"]).filter(pa.array(~enters))

    id_kind = rows.schema["id"].dataType.simpleString()
    placed = timed.select("name", "slice", "t").repartition("name", "slice").sortWithinPartitions("name", "slice", "t")
    told = placed.mapInArrow(facts, "name string, slice long, n long, heads array<long>, starts array<long>, counts array<long>")
    entered = told.repartition("name").sortWithinPartitions("name", "slice").mapInArrow(chain, "name string, slice long, start long, held long")
    both = timed.unionByName(entered, allowMissingColumns=True).repartition("name", "slice").sortWithinPartitions("name", "slice", F.col("t").asc_nulls_first(), "id")
    done = both.select("id", "slice", "t", "start", "held").mapInArrow(count, f"id {id_kind}, allowed boolean")
    return done.unionByName(rows.where("ts is null").select("id", F.lit(False).alias("allowed")))
