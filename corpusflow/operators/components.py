"""Distributed connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.runtime import materialize


def _contract(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, each once, larger end first."""
    hi = root.select(F.col("node").alias("hi"), F.col("up").alias("hi_up"))
    lo = root.select(F.col("node").alias("lo"), F.col("up").alias("lo_up"))
    a, b = F.col("hi_up"), F.coalesce("lo_up", "lo")
    return (
        edges.join(hi, "hi")
        .join(lo, "lo", "left")
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi <> lo")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every end of an edge; the component is its smallest node.

    Each round every node points at its smallest smaller neighbour (a partial
    aggregate, so hubs cost nothing), pointers are doubled until all of them reach
    a local minimum, and the edges are redrawn between those minima.  At least
    half of the nodes vanish in a round.  The joins read materialised tables, so
    adaptive execution can split a hub's rows.  Null ends and self-links are
    ignored; repeated links count once; an empty table gives an empty result.
    """
    start = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    levels, live = [], start
    while not live.isEmpty():
        root = materialize(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")))
        while True:
            above = root.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = materialize(
                root.join(above, "up", "left").select(
                    "node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")
                )
            )
            root = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        levels.append(root)
        live = materialize(_contract(live, root))
    found = start.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node"))
    for root in levels:
        up = root.select(F.col("node").alias("component"), "up")
        found = found.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return found
