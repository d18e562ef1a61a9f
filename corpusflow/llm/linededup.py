"""Lines that many documents share, found through levelled sorted runs of line hashes; DataFrame functions only.

The lines of a corpus arrive in batches.  What is known of the earlier ones lies
in runs: tables of ``(h1, h2, n, keep_id)``, bucketed by the two line hashes and
sorted by them, so that a batch meets a run in a merge join without moving the
run.  A batch is anti-joined with the entries that are settled (found in enough
documents already) and the rest becomes a run of its own.  ``fanout`` runs of one
level are merged into one run of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.runtime import materialize, shared_folder, stored

MIN_LENGTH = 20
MIN_DOCS = 3
BATCHES = 8
FANOUT = 4
#: Keys in more than a HOT-th of all kept places: fewer than HOT of them exist, so their table may be broadcast.
HOT = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def lines_of(text: str = "text") -> Column:
    """The text split at line feeds; null and empty texts are one empty line."""
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _row_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def places(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, row, pos, h1, h2``: every line whose key has ``min_length`` code points, with a hash of 128 bits of its key.

    ``row`` is a hash of the text, which tells rows of one ``doc_id`` apart.
    """
    lines = docs.select("doc_id", _row_hash().alias("row"), F.posexplode(lines_of()).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of line hashes.

    Batches must hold whole documents and come from larger to smaller ``doc_id``:
    then an entry that is settled needs no more of the later ones.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, entries: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(full)))
            self._forget(full)

    def _merged(self, runs: list[str]) -> DataFrame:
        """One entry a key: documents added up, the largest id kept."""
        # Read as files: a union of bucketed tables keeps their partitioning in Spark 4.1, but not the rows of a bucket together.
        rows = self.spark.read.schema(self.spark.table(runs[0]).schema).parquet(*[f"{self.folder}/{r}" for r in runs])
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"))

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add the lines ``doc_id, h1, h2`` of a batch as a run; keys that a run has settled are left out."""
        own = batch.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))  # a line counts once a document; spreads a hot line over its documents
        own = own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
        for run in self.runs:
            own = own.join(self.spark.table(run).where(F.col("n") >= self.min_docs).select(*KEY), KEY, "left_anti")
        self._push(0, self._write(own))

    def shared(self) -> DataFrame:
        """``h1, h2, n, keep_id`` of the lines found in enough documents, written; the runs are dropped."""
        out = stored(self._merged(self.runs).where(F.col("n") >= self.min_docs))
        self._forget(self.runs)
        self.levels = []
        return out


def _batches(docs: DataFrame, batches: int) -> Column:
    """Number of the batch of a document: slices of like size, the largest ids first, a null id last."""
    parts = [i / batches for i in range(1, batches)]
    cuts = docs.select(F.percentile_approx("doc_id", parts, 1_000).alias("c")).first()["c"] if parts else None
    number = sum((F.when(F.col("doc_id") < c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    return F.when(F.col("doc_id").isNull(), batches).otherwise(number)


def dropped_places(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, row, dropped``: the positions of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    found = places(docs, min_length).withColumn("batch", _batches(docs, batches))
    found.write.partitionBy("batch").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for number in sorted(r.batch for r in found.select("batch").distinct().collect()) or [0]:  # at most ``batches`` + 1 numbers
        runs.add(found.where(F.col("batch") == number).select("doc_id", *KEY))
    shared = runs.shared()
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    thin = found.select("doc_id", "row", "pos", *KEY)
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    common = F.broadcast(shared.where(hot).drop("n"))  # fewer than HOT rows
    gone = thin.join(common, KEY).where(elsewhere).select("doc_id", "row", "pos")
    rest = thin.join(F.broadcast(shared.where(hot).select(*KEY)), KEY, "left_anti").join(shared.where(~hot).drop("n"), KEY)
    gone = gone.unionByName(rest.where(elsewhere).select("doc_id", "row", "pos"))
    return materialize(gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped")))  # at most a document's lines


def drop_shared_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The rows of ``docs`` with ``text`` less the lines that many documents share, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of ``min_length`` code points or more that ``min_docs`` documents hold lose
    all their lines except in the largest ``doc_id`` that holds them.  The other
    lines stay, joined by line feeds.

    Null and empty texts are one empty line and become empty.  Rows that repeat a
    ``doc_id`` are one document, each with lines of its own; rows without an id are
    one document, smaller than any other.  Columns named ``n_lines`` or ``n_dropped``
    are replaced; others stay as they are.  An empty table gives no rows.
    """
    gone = dropped_places(docs, min_length, min_docs, batches, fanout).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("dropped").alias("__gone"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(*others, F.col("text").cast("string").alias("text")).withColumn("__own", _row_hash())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__row"))
    rows = rows.join(gone, same, "left").withColumn("__lines", lines_of())
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")  # a hash set: linear in the lines
    kept = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    return rows.select(*others, text.alias("text"), F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
