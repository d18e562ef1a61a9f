"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.runtime import global_rank, materialize, partition_prefix_sums

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code-point order, null last, take the weights in turn and share the
    total size; a target stops at ``most`` times its source's size and the excess
    is shared again by weight until none is above.  That fixed point has a level
    ``L`` with ``target = min(most * size, weight * L)``: with sources sorted by
    ``size / weight``, the capped ones are a prefix, found from running sums.
    """
    total = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = [F.col("source").asc_nulls_last()]
    ranked = global_rank(total, order, "at")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight")))
    ratio = F.col("source_size") / F.col("weight")
    sums = {"size_below": F.col("source_size"), "weight_below": F.col("weight")}
    summed = materialize(partition_prefix_sums(ranked, [ratio.asc(), *order], sums))
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    # The level if the sources before this one are capped; the first that is not above its cap sets it.
    level = (F.col("all_size") - most * (F.col("size_below") - F.col("source_size"))).cast("double") / (
        F.col("all_weight") - F.col("weight_below") + F.col("weight")
    ).cast("double")
    fits = F.col("weight") * level <= most * F.col("source_size")
    levels = summed.crossJoin(F.broadcast(whole)).where(fits).agg(F.min(F.struct(F.col("weight_below").alias("at"), level.alias("level"))).alias("first"))
    level = F.coalesce(F.col("first.level"), F.lit(0.0))  # one row beside each source
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * level)
    return ranked.crossJoin(F.broadcast(levels)).select("source", "source_size", target.alias("target"))


def uniform(seed: str = SEED, key: str = "doc_id") -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


BROADCAST_SOURCES = 50_000


def with_copies(docs: DataFrame, planned: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies``: floor(rate) plus a Bernoulli copy of the fraction.

    ``planned``, one row per source, is broadcast up to ``BROADCAST_SOURCES`` rows, so a hot source moves no texts.
    """
    plan = planned.select(F.col("source").alias("__source"), "source_size", "target")
    plan = F.broadcast(plan) if planned.count() <= BROADCAST_SOURCES else plan
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(uniform(seed) < rate - F.floor(rate), 1).otherwise(0)
    joined = docs.join(plan, docs["source"].eqNullSafe(plan["__source"]), "left").drop("__source")
    return joined.withColumn("copies", copies.cast("long"))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; the texts are read once."""
    sizes = materialize(docs.select("doc_id", "source", size_of().alias("size")))
    planned = materialize(targets(sizes, weights, most))
    out = with_copies(sizes, planned, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: every document as often as it is drawn, with its own columns.

    A null text has size 0, a null source is a source of its own and comes last, a
    null ``doc_id`` draws as the word ``null``; repeated rows draw alike.  An empty
    table, or one without words, gives no rows.
    """
    planned = materialize(targets(docs.select("source", size_of().alias("size")), weights, most))
    thin = planned.withColumnsRenamed({"source_size": "__size", "target": "__target"})
    names = [F.col(c) for c in docs.columns]
    base = docs.select(F.struct(*names).alias("__row"), "doc_id", "source")
    drawn = with_copies(base, thin.withColumnsRenamed({"__size": "source_size", "__target": "target"}), seed)
    return drawn.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
