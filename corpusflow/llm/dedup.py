"""Exact de-duplication by skew-safe combining.

Equal texts are combined in three stages, each of which compares full content
because the text itself is a grouping key beside its digest: inside every input
partition (the partial aggregate), in salted digest groups, and over the salt
winners.  A text that fills a third of the corpus reaches the last stage as one
row per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.runtime import materialize

SALTS = 8


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def classes(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """``(digest, content, keep_id, group_size)``: one row per distinct normalised text."""
    rows = docs.select("doc_id", normalised().alias("content")).select("doc_id", "content", digest(F.col("content")).alias("digest"))
    salted = rows.groupBy("digest", "content", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    return salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``.

    ``keep_id`` is the smallest ``doc_id`` among equal texts (null only if all are
    null).  Of repeated rows with that id exactly one is ``kept``.  Null and empty
    texts are equal.  Digests that different texts share (none for SHA-256) are
    resolved by comparing the texts again.  Other columns are ignored; an empty
    table gives no rows.
    """
    found = classes(docs, digest, salts)
    whole = found.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )  # without the texts: a digest of one text needs no second comparison
    whole = materialize(whole)
    clashing = whole.where("texts > 1").select("digest")
    has_clash = not clashing.isEmpty()
    keys = ["digest", "content"] if has_clash else ["digest"]
    thin = docs.select("doc_id", normalised().alias("content")).select("doc_id", "content", digest(F.col("content")).alias("digest"))
    copies = Window.partitionBy(*keys, "doc_id").orderBy(F.lit(0))
    thin = thin.select("doc_id", *keys).withColumn("copy", F.row_number().over(copies))
    marked = thin.join(whole.where("texts = 1").drop("texts"), "digest").drop("content")
    if has_clash:
        several = found.join(clashing, "digest", "left_semi")
        marked = marked.unionByName(thin.join(several, keys).drop("content"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return marked.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


BROADCAST_ROWS = 100_000


def distinct_documents(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with their own columns: of equal texts the one with the smallest ``doc_id``.

    Of rows that repeat that id with equal texts, the one with the smallest
    unnormalised text stays.  A null ``doc_id`` loses to any other; null and empty
    texts are equal; an empty table gives no rows.
    """
    found = exact_groups(docs, salts=salts).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    found = materialize(found.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")))
    gone, twice = found.where("not stays").select("__id", "__digest"), found.where("stays and n > 1").select("__id", "__digest")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    small = gone.count() <= BROADCAST_ROWS  # ids and digests only; a longer list meets the documents in a shuffle
    kept = docs.withColumn("__own", sha256(normalised())).join(F.broadcast(gone) if small else gone, same, "left_anti")
    if not twice.isEmpty():
        one = Window.partitionBy("doc_id", "__own").orderBy(F.col("text").asc_nulls_first())
        some = kept.join(twice, same, "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
        kept = kept.join(twice, same, "left_anti").unionByName(some)
    return kept.select(*docs.columns)
