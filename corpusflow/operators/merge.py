"""Next-snapshot operators: keep-first, insert-if-absent, upserts and deletes as plans over the current snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key are kept once like any other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_per(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def merge(
    target: DataFrame, changes: DataFrame, keys: list[str], matched: dict[str, Column] | None = None, insert: bool = True, when: Column | None = None, order: list[Column] | None = None
) -> DataFrame:
    """Upsert ``changes`` into ``target``: its next snapshot.

    Of changes with the same keys the first by ``order`` counts (default: by their
    other columns), so no row of ``target`` is multiplied.
    ``matched`` gives the new value of columns on a conflict, over ``t.`` and
    ``c.`` columns (default: every column of ``changes``); ``when`` limits updates;
    ``insert=False`` leaves unmatched changes out.
    """
    others = [F.col(x) for x in changes.columns if x not in keys]
    changes = keep_first(changes, keys, order or others or [F.lit(0)])
    t, c = target.withColumn("__t", F.lit(True)).alias("t"), changes.withColumn("__c", F.lit(True)).alias("c")
    cond = None
    for k in keys:
        one = F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}"))
        cond = one if cond is None else cond & one
    joined = t.join(c, cond, "full_outer" if insert else "left")
    in_t, in_c = F.col("t.__t").isNotNull(), F.col("c.__c").isNotNull()
    update = in_t & in_c & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    matched = {k: F.col(f"c.{k}") for k in changes.columns if k not in keys} if matched is None else matched
    out = []
    for name in target.columns:
        new = F.col(f"c.{name}") if name in changes.columns else F.lit(None)
        value = F.when(~in_t, new)
        if name in matched:
            value = value.when(update, matched[name])
        out.append(value.otherwise(F.col(f"t.{name}")).cast(target.schema[name].dataType).alias(name))
    return joined.select(*out)


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` with the first row of each key it does not hold."""
    new = keep_first(rows, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def delete_articles(articles: DataFrame, digest_items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and digest items without the given ids; followers of a deleted leader lose their parent."""
    gone = ids.select(F.col("id")).distinct()
    left = articles.join(gone, "id", "left_anti")
    parent = gone.select(F.col("id").alias("parent_article_id"), F.lit(True).alias("__gone"))
    left = left.join(parent, "parent_article_id", "left").withColumn("parent_article_id", F.when(F.col("__gone").isNull(), F.col("parent_article_id")))
    items = digest_items.join(gone.withColumnRenamed("id", "article_id"), "article_id", "left_anti")
    return left.select(*articles.columns), items


def delete_sources(sources: DataFrame, articles: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without the given ids, and articles without those of the deleted sources."""
    gone = ids.select("id").distinct()
    return sources.join(gone, "id", "left_anti"), articles.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")


def run_log(runs: DataFrame) -> DataFrame:
    """Log rows with a status from errors and inserted counts."""
    status = F.when(F.col("errors") == 0, "success").when(F.col("items_inserted") > 0, "partial").otherwise("failed")
    return runs.withColumn("status", status)


def add_counters(target: DataFrame, hits: DataFrame, key: str, count: str, last: str) -> DataFrame:
    """``target`` with hit counts added and last times raised."""
    sums = hits.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"))
    out = target.join(sums, key, "left")
    return out.withColumn(count, F.coalesce(count, F.lit(0)) + F.coalesce("__n", F.lit(0))).withColumn(last, F.greatest(last, "__at")).select(*target.columns)
