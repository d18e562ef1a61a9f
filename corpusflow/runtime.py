"""Session set-up, reliable cutting of lineage and a distributed row number."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusflow")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one named in ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave it unset and gets a temporary
    folder; on a cluster an unset folder is an error, because executors would
    write to disks that the others cannot read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusflow-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a checkpoint and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


TEXT_ROWS = 1_000
TEXT_BYTES = "16m"


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hand texts to Python in batches of at most ``rows`` rows and about ``TEXT_BYTES`` from now on, so that long texts do not fill a worker; smaller numbers of rows and given limits of bytes stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, TEXT_BYTES)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: for wide tables of which later steps read a few columns each."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partition_prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """Running sums (current row included) over a total order, without a single-task window.

    Rows are range-partitioned on ``order``; each slice is summed on its own and
    is offset by the totals of the slices before it (one row per slice).  Ties in
    ``order`` take an arbitrary but fixed place, because the slices are materialised.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.select("*", *[c.alias(f"__v_{name}") for name, c in sums.items()])
        .repartitionByRange(slices, *order)
        .withColumn("__slice", F.spark_partition_id())
    )
    totals = placed.groupBy("__slice").agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    offsets = totals.select("__slice", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    within = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "__slice")  # as many rows as slices
    running = [(F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(within)).alias(n) for n in sums]
    return out.select(*df.columns, *running)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in a total order, computed slice by slice."""
    return partition_prefix_sums(df, order, {name: F.lit(1).cast("long")})
