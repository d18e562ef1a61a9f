"""Snapshots of the logical tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import schemas
from corpusflow.functions.dates import local_date

SCHEMAS = {"sources": schemas.SOURCES, "articles": schemas.ARTICLES, "article_fetch_jobs": schemas.JOBS, "scrape_logs": schemas.LOGS, "blocklist": schemas.BLOCKLIST}


def read_table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A snapshot with its schema; columns that an older snapshot lacks are null."""
    rows = spark.read.schema(SCHEMAS[name]).parquet(path)
    return rows.select(*columns) if columns else rows


def write_snapshot(rows: DataFrame, path: str, day: Column | None = None) -> None:
    """The next snapshot, in a new folder (it fails if the folder is there), by local day if a time is given."""
    if day is None:
        rows.write.parquet(path)
    else:
        rows.withColumn("local_date", local_date(day)).repartition("local_date", F.spark_partition_id() % 8).write.partitionBy("local_date").parquet(path)
