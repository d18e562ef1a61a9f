"""Forum threads: useful comments, discussion gates and the text of a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.functions.classify import comment_key, comment_score, is_useful_comment


def scored(comments: DataFrame) -> DataFrame:
    return comments.withColumn("score", comment_score(F.col("body"), F.col("reactions"), F.col("page"), F.col("order")))


def best_comments(comments: DataFrame, most: int = 10) -> DataFrame:
    """Useful comments, the first of equal texts, the ``most`` best of each thread by score, reactions and place."""
    rows = scored(comments).withColumn("key", comment_key(F.col("body"))).where((F.length("key") >= 12) & is_useful_comment(F.col("body")))
    first = Window.partitionBy("thread", "key").orderBy("page", "order", "author")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    best = Window.partitionBy("thread").orderBy(F.col("score").desc(), F.col("reactions").desc(), "page", "order")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("key")


def thread_gate(comments: DataFrame, least: int = 10, least_useful: int = 3) -> DataFrame:
    """Why a thread is skipped: nothing fetched, few comments, few useful ones, or not at all."""
    n = comments.groupBy("thread").agg(F.count(F.lit(1)).alias("comments"), F.count_if(is_useful_comment(F.col("body"))).alias("useful"))
    why = F.when(F.col("comments") == 0, "fetch_failed").when(F.col("comments") < least, "few_comments").when(F.col("useful") < least_useful, "few_useful")
    return n.withColumn("skip_reason", why)


def thread_texts(comments: DataFrame, most: int = 10) -> DataFrame:
    """A thread as text: the opening post, the counts, the chosen comments in thread order (at most ``most`` a thread)."""
    opening = comments.groupBy("thread").agg(F.min_by("body", F.struct("page", "order", "author")).alias("op"), F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("["), F.coalesce("author", F.lit("unknown")), F.lit("] "), F.substring("body", 1, 200))
    chosen = best_comments(comments, most).groupBy("thread").agg(F.sort_array(F.collect_list(F.struct("page", "order", line.alias("line")))).alias("c"))
    text = F.concat_ws(
        "\n", F.substring("op", 1, 300), F.concat(F.lit("Comments: "), F.col("n").cast("string"), F.lit(", chosen: "), F.size(F.coalesce("c", F.array())).cast("string")),
        F.array_join(F.transform("c", lambda s: s["line"]), "\n"),
    )
    return opening.join(chosen, "thread", "left").select("thread", text.alias("text"))


def run_counters(threads: DataFrame, kind: str = "kind") -> DataFrame:
    """Counters of a run per forum kind, with the fetch strategies as a map."""
    per = threads.groupBy(kind, "strategy").agg(F.count(F.lit(1)).alias("tries"), F.count_if("ok").alias("wins"))
    maps = per.groupBy(kind).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "wins")))).alias("strategy_wins"))
    sums = threads.groupBy(kind).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("inserted").alias("inserted"), F.count_if(F.col("skip_reason") == "few_comments").alias("few_comments"),
        F.count_if(F.col("skip_reason") == "few_useful").alias("few_useful"),
    )
    return sums.join(maps, kind)
