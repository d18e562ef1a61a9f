"""Bounded samples of labelled rows, for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def bounded(docs: DataFrame, most: int, labels: DataFrame | None = None) -> DataFrame:
    """Exactly ``most`` of the distinct rows of ``docs``, or all if they are fewer: those of the smallest hashes.

    With ``labels(doc_id, label)``, only labelled rows, with their ``label``.  The
    hash is of the whole row, so repeated rows count once, rows that repeat an id
    or lack one are told apart by their other columns, and every run chooses alike.
    Only hashes are sorted; texts of chosen rows alone are moved.  ``hash`` is kept
    as a column for an order that does not depend on partitions.
    """
    keyed = docs.withColumn("hash", F.xxhash64(*docs.columns))
    thin = keyed.select("doc_id", "hash") if labels is None else keyed.select("doc_id", "hash").join(labels, "doc_id")
    label = [] if labels is None else [F.max("label").alias("label")]
    chosen = thin.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), *label).drop("n").orderBy("hash").limit(most)
    return keyed.join(F.broadcast(chosen), "hash").dropDuplicates(["hash"])  # ``chosen`` has at most ``most`` rows
