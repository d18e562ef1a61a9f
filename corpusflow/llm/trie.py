"""Prefix trie of conversations, summed up over subtrees by the Euler-tour technique.

Every node gives an enter and an exit arc; each arc names its successor in a tour
of the trie.  The tour is ranked by pointer jumping towards randomly chosen ruling
arcs, level by level, so that each level has a small part of the arcs of the one
below.  Leaves and savings of a subtree are then differences of prefix sums at the
positions of its two arcs.  Nothing passes a single task but bounded remainders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.runtime import global_rank, materialize, partition_prefix_sums

FAMILY = 5
SHARED_TURNS = 9
#: One arc in RULING rules the arcs before it; up to LAST arcs are ranked by one window.
RULING = 16
LAST = 20_000
#: Ids a piece when the conversations that end at a node are joined to one text.
PIECE = 4_096
LANES = ("s0", "s1", "s2", "s3")


def keyed_prefix_sums(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums within each ``key`` in the order given, though a key may hold most rows.

    Rows are range-partitioned by key and order and summed slice by slice.  Of each
    slice only its first key can begin in slices before; those offsets are one row a
    slice.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()], F.monotonically_increasing_id().alias("__row"))  # deals out equal rows
    placed = materialize(values.repartitionByRange(slices, F.col(key), *order, F.col("__row")).withColumn("__slice", F.spark_partition_id()))
    edge = placed.groupBy("__slice").agg(F.min(key).alias("first"), F.max(key).alias("last"))  # a key in two slices is the last one of the first of them
    edge = edge.select(F.explode(F.array_distinct(F.array("first", "last"))).alias(key), "__slice")
    ends = placed.join(F.broadcast(edge), [key, "__slice"]).groupBy(key, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # at most two rows a slice
    offsets = ends.select(key, "__slice", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    within = Window.partitionBy("__slice", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), [key, "__slice"], "left")
    return out.select(*df.columns, *[(F.coalesce(f"__o_{n}", F.lit(0)) + F.sum(f"__v_{n}").over(within)).alias(n) for n in sums])


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED_TURNS))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, content, bytes``: the turns of every rebuilt conversation, numbered from 1; one row of depth 0 each besides.

    A conversation c begins with the first h turns of conversation c - c % 5 (all if
    it has fewer, none if it is absent) and goes on with its own turns after its
    first h; h = crc32(c) % 9.  ``content`` is a digest of role and text, ``bytes``
    the length of the text in UTF-8.

    Turns are ordered by number, null first; turns of one number by their digest.
    Null roles and texts are empty; rows without a ``conv_id`` belong to no
    conversation and are left out.  Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    thin = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    turns = keyed_prefix_sums(thin, "conv_id", [F.col("turn").asc_nulls_first(), F.col("content")], {"pos": F.lit(1)})
    turns = materialize(turns.select("conv_id", "pos", "content", "bytes"))
    every = turns.groupBy("conv_id").agg(F.least(F.max("pos"), F.lit(SHARED_TURNS - 1)).alias("n"))
    own = F.col("conv_id")
    every = every.select(own, "n", shared_turns(own).alias("h"), (own - own % FAMILY).alias("base"))
    opening = every.join(every.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    opening = materialize(opening.select("conv_id", "h", "base", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    first = turns.where(F.col("pos") < SHARED_TURNS).withColumnRenamed("conv_id", "base")  # at most 8 rows a conversation
    lent = opening.join(first, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "content", "bytes")
    rest = turns.where(F.col("pos") > shared_turns(own)).join(opening.select("conv_id", "h", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "content", "bytes")
    start = opening.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("content"), F.lit(0).cast("long").alias("bytes"))
    return start.unionByName(lent).unionByName(rest)


def _nodes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and ``(node, conv_id)`` of the conversations that end at each.

    A prefix is told by its depth and the sums of four 32-bit lanes of the hashes of
    (depth, content) over its turns: the sums of its parent follow from those of its
    last turn, and sums need no order.
    """
    at = [F.xxhash64(F.lit(seed), "depth", "content") for seed in (1, 2)]
    half = [f(h) for h in at for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = turns.select("*", *[F.when(F.col("depth") > 0, c).otherwise(0).alias(f"own_{lane}") for lane, c in zip(LANES, half, strict=True)])
    rows = keyed_prefix_sums(rows, "conv_id", [F.col("depth")], {lane: F.col(f"own_{lane}") for lane in LANES})
    parent = F.when(F.col("depth") > 0, F.struct(*[(F.col(lane) - F.col(f"own_{lane}")).alias(lane) for lane in LANES]))
    rows = materialize(rows.select("conv_id", "depth", "bytes", F.struct(*LANES).alias("key"), parent.alias("parent_key")))
    found = rows.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.first("parent_key").alias("parent_key")
    )  # members of a node agree in bytes and parent
    found = materialize(global_rank(found, [F.col("depth"), F.col("parent_key"), F.col("conv_id")], "node"))  # siblings are neighbours
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = materialize(found.join(up, ["depth", "parent_key"], "left").drop("parent_key"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("m")).select("conv_id", "m.*")
    return nodes.drop("key"), last.join(nodes.select("depth", "key", "node"), ["depth", "key"]).select("node", "conv_id")


def tour(nodes: DataFrame) -> DataFrame:
    """``arc, next`` of the Euler tour over ``nodes(node, parent)``, numbered so that siblings are neighbours; arc 2 n enters node n, 2 n + 1 leaves it."""
    child = nodes.where("parent is not null")
    down = child.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    after = child.select((F.col("node") - 1).alias("node"), F.col("parent").alias("again"))
    both = nodes.select("node", "parent").join(down, "node", "left").join(after, "node", "left")
    enter = F.struct((F.col("node") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1).alias("next"))
    leave = F.when(F.col("again") == F.col("parent"), (F.col("node") + 1) * 2).otherwise(F.col("parent") * 2 + 1)  # null after the root
    return both.select(F.inline(F.array(enter, F.struct((F.col("node") * 2 + 1).alias("arc"), leave.alias("next")))))


def list_rank(arcs: DataFrame, ruling: int = RULING, last: int = LAST, level: int = 0) -> DataFrame:
    """``arc, left`` for a list ``arc, next`` (``next`` null at its end): how many arcs follow each.

    One arc in ``ruling``, chosen by a hash, rules.  Every arc jumps along its
    successors, twice as far each round, until it reaches a ruling arc or the end:
    with a high probability after log2(ruling * ln n) rounds.  The ruling arcs, with
    the distances between them as weights, are ranked in the same way.
    """
    live = materialize(arcs.select("arc", "next", (F.col("weight") if "weight" in arcs.columns else F.lit(1).cast("long")).alias("weight")))
    if live.count() <= last:
        return _rank_rest(live)
    rules = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(ruling)) == 0
    arrived = F.col("next").isNull() | rules(F.col("next"))
    ready, moving = live.where(arrived), live.where(~arrived)
    pieces = [ready]
    # The arcs that others may land on are those that have not arrived or have just done so.
    target = live.where(~rules(F.col("arc")))
    while not moving.isEmpty():
        step = target.select(F.col("arc").alias("next"), F.col("next").alias("far"), F.col("weight").alias("more"))
        jumped = moving.join(step, "next").select("arc", F.col("far").alias("next"), (F.col("weight") + F.col("more")).alias("weight"))
        jumped = materialize(jumped)
        now = target.where(arrived).unionByName(jumped.where(~rules(F.col("arc"))))
        pieces.append(jumped.where(arrived))
        moving, target = jumped.where(~arrived), materialize(now)
    reached = pieces[0]
    for piece in pieces[1:]:
        reached = reached.unionByName(piece)
    reached = materialize(reached)
    above = list_rank(reached.where(rules(F.col("arc"))), ruling, last, level + 1)
    above = above.select(F.col("arc").alias("next"), F.col("left").alias("beyond"))
    return reached.join(above, "next", "left").select("arc", (F.col("weight") + F.coalesce("beyond", F.lit(0))).alias("left"))


def _rank_rest(live: DataFrame) -> DataFrame:
    """The same for a list of bounded length, walked by one task."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        before = {n: (a, w) for a, n, w in zip(rows["arc"], rows["next"], rows["weight"], strict=True) if not pd.isna(n)}
        end = rows[rows["next"].isna()]
        at, left, out = int(end["arc"].iloc[0]), int(end["weight"].iloc[0]), {}
        while True:
            out[at] = left
            if at not in before:
                return pd.DataFrame({"arc": list(out), "left": list(out.values())}, dtype="int64")
            at, weight = before[at]
            left += weight

    return live.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(walk, "arc long, left long")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``node, n_leaves, saved_tokens`` from prefix sums over the ranked tour."""
    order = list_rank(tour(nodes)).withColumn("node", F.floor(F.col("arc") / 2)).withColumn("enters", F.col("arc") % 2 == 0)
    weights = nodes.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    arcs = order.join(weights, "node")
    own = {"leaves": F.when(F.col("enters"), F.col("leaf")).otherwise(0), "savings": F.when(F.col("enters"), F.col("saved")).otherwise(0)}
    summed = partition_prefix_sums(arcs, [F.col("left").desc()], {k: v.cast("long") for k, v in own.items()})
    before = lambda s, w: F.max(F.when(~F.col("enters"), F.col(s))) - F.max(F.when(F.col("enters"), F.col(s) - F.col(w)))
    return summed.groupBy("node").agg(before("leaves", "leaf").alias("n_leaves"), before("savings", "saved").alias("saved_tokens"))


def _pieces_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come sorted; only the running digest of one node is held."""
    node, running = None, None
    for batch in batches:
        done = []
        for own, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if own != node:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = own, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([running.hexdigest()], pa.string())], ["node", "ends_sha256"])


def _ends(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``node, ends_sha256`` of nodes at which conversations end.

    The ids are sorted and joined in pieces of ``piece`` places of the global order.
    Nodes of one piece are hashed at once; the pieces of others are read in order by
    one task a node, which SHA-256 needs, without being held there.
    """
    ranked = global_rank(ends, [F.col("node"), F.col("conv_id")], "seq").withColumn("piece", F.floor(F.col("seq") / piece))
    texts = ranked.groupBy("node", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    texts = materialize(texts)
    many = texts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    one = texts.join(many, "node", "left_anti").select("node", F.sha2(F.col("text").cast("binary"), 256).alias("ends_sha256"))
    several = texts.join(many, "node").repartition("node").sortWithinPartitions("node", "piece").select("node", "text")
    return one.unionByName(several.mapInArrow(_pieces_hashed, "node long, ends_sha256 string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``turns(conv_id, depth, content, bytes)`` with a row of depth 0 each, as of ``rebuilt``.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the whole
    subtree, ``ends_sha256`` of the ids that end here.  A conversation without turns
    is a member of the root only.  Without conversations there are no rows.
    """
    nodes, ends = _nodes(turns)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    out = nodes.join(_subtrees(nodes), "node").join(_ends(ends), "node", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
