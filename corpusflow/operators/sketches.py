"""Counts and distinct counts by day, stored as sketches that merge over batches and ranges of days.

Each batch writes one row for each day it touches: plain counts and one HyperLogLog
sketch for each distinct count.  Days and ranges are merged from these rows, so no
batch reads what came before, and a late one adds to its own days only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two; the standard error of a distinct count is about 0.83 / sqrt(2 ** 14), 0.65 %.
LOG_REGISTERS = 14


@dataclass(frozen=True)
class Daily:
    """What is kept of each day, as SQL expressions: ``counts`` of rows that hold a condition, ``distinct`` values (nulls are none)."""

    day: str
    counts: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)

    def schema(self) -> str:
        return ", ".join(["day date", "batch int", *[f"{c} long" for c in self.counts], *[f"{c} binary" for c in self.distinct]])


def add_batch(rows: DataFrame, kept: Daily, folder: str, batch: int) -> None:
    """Store the rows of one batch; running a batch again replaces it."""
    counts = [F.count_if(F.expr(c)).alias(name) for name, c in kept.counts.items()]
    sketches = [F.hll_sketch_agg(F.expr(c), LOG_REGISTERS).alias(name) for name, c in kept.distinct.items()]
    days = rows.groupBy(F.expr(kept.day).alias("day")).agg(*counts, *sketches)
    days.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/sketches/batch={batch}")


def _stored(spark: SparkSession, kept: Daily, folder: str, since: date | None, until: date | None) -> DataFrame:
    out = spark.read.schema(kept.schema()).parquet(f"{folder}/sketches")
    if since is not None:
        out = out.where(F.col("day") >= F.lit(since))
    return out if until is None else out.where(F.col("day") <= F.lit(until))


def _merged(kept: Daily) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kept.counts] + [F.hll_union_agg(c).alias(c) for c in kept.distinct]


def _estimated(kept: Daily) -> list[Column]:
    return [F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) for c in kept.distinct]


def by_day(spark: SparkSession, kept: Daily, folder: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """``day``, counts and distinct counts of every day stored, of a range of days if given; only their folders are read.

    Distinct counts are estimates, but for days that ``repair`` counted after the last batch that touched them.
    """
    stored = _stored(spark, kept, folder, since, until)
    days = stored.groupBy("day").agg(*_merged(kept), F.max("batch").alias("batch")).select("day", "batch", *kept.counts, *_estimated(kept))
    exact = _exact(spark, kept, folder)
    if exact is None:
        return days.drop("batch")
    out = days.join(exact, F.col("day").eqNullSafe(F.col("__day")), "left")
    holds = F.col("__batch") >= F.col("batch")
    return out.select("day", *kept.counts, *[F.when(holds, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in kept.distinct])


def over_range(spark: SparkSession, kept: Daily, folder: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """One row: counts and distinct counts over a range of days, both ends included; a value of several days counts once."""
    return _stored(spark, kept, folder, since, until).agg(*_merged(kept)).select(*kept.counts, *_estimated(kept))


def repair(rows: DataFrame, kept: Daily, folder: str, batch: int) -> None:
    """Count the distinct values of the days of ``rows`` exactly; ``rows`` are all rows of these days in batches up to ``batch``.

    The figures hold for a day until a later batch touches it.
    """
    exact = rows.groupBy(F.expr(kept.day).alias("day")).agg(*[F.count_distinct(F.expr(c)).alias(name) for name, c in kept.distinct.items()])
    exact.write.mode("overwrite").parquet(f"{folder}/exact/batch={batch}")


def _exact(spark: SparkSession, kept: Daily, folder: str) -> DataFrame | None:
    """The last exact figures of each day, or None if there are none."""
    schema = ", ".join(["day date", "batch int", *[f"{c} long" for c in kept.distinct]])
    try:
        found = spark.read.schema(schema).parquet(f"{folder}/exact")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = found.groupBy(F.col("day").alias("__day")).agg(F.max("batch").alias("__batch"), F.max_by(F.struct(*kept.distinct), "batch").alias("m"))
    return last.select("__day", "__batch", *[F.col(f"m.{c}").alias(f"__{c}") for c in kept.distinct])


#: Visits from outside: all, humans, bots and the addresses of humans.
VISITS = Daily(
    "date", {"total": "not is_internal", "humans": "not is_internal and not is_bot", "bots": "not is_internal and is_bot"},
    {"unique_ips": "if(not is_internal and not is_bot, ip, null)"},
)
