"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Vectors are dealt to bands of like norms and, by a hash, to shards of a bounded
number of rows.  In a shard, maximum inner product becomes nearest neighbour by one
added coordinate, which no longer vector of another band can swamp.  Greedy
searches from the medoid propose neighbours for each vector; pruning keeps a
candidate only if no kept neighbour is closer to it by the factor ``alpha``, so
edges stay few and diverse.  Vectors that no path reaches get an edge from their
nearest reachable one.  The finished graphs are written to the shared folder;
queries then stream past every shard's graph in blocks, each query with its own
beam, and the queries of a shard are dealt to several tasks.  Scores are exact
inner products of the original vectors.

Every query meets every shard, so the work grows with the product of queries and
shards; one in twenty rows as queries is meant for tables of up to about 10^8
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.runtime import materialize, stored

SHARD_ROWS = 16_384
DEGREE, BEAM, ALPHA, BLOCK = 28, 80, 1.15, 512
#: The beam of a query: wider than that of building, because a query from another shard is no node of the graph.
SEARCH = 240
#: Places for edges to vectors that pruning left unreachable, beside ``DEGREE``.
SPARE = 4
#: Tasks that share the queries of one shard.
SPLITS = 4


class Graph:
    """A robust-pruned graph over distinct vectors of one length, held by one task; ``near`` and ``entry`` are given for a finished one."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, near: np.ndarray | None = None, entry: int | None = None):
        scaled = vectors / np.abs(vectors).max()  # in double precision, so that no square overflows or vanishes
        norms = (scaled**2).sum(axis=1)
        scaled, norms = scaled / np.sqrt(norms.max()), norms / norms.max()
        self.x = np.hstack([scaled, np.sqrt(np.maximum(1 - norms, 0))[:, None]]).astype(np.float32)
        self.sq = (self.x**2).sum(axis=1)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        if near is not None:
            self.near, self.entry = near, entry
            return
        self.near = np.full((len(self.x), degree + SPARE), -1, np.int32)
        self.entry = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        self._build()
        self._reach_all()

    def _build(self) -> None:
        n = len(self.x)
        order = np.random.default_rng(0).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done, size = 1, 64
        while done < n:  # blocks grow with the graph that they search
            block = order[done : done + min(size, 1024)]
            ids, _ = self.search(self.x[block], self.beam)
            self._connect(block, ids)
            done, size = done + len(block), size * 2
        for at in range(0, n, 1024):  # a second pass, now over the whole graph
            block = order[at : at + 1024]
            ids, _ = self.search(self.x[block], self.beam)
            self._connect(block, np.hstack([ids, self.near[block]]))

    def _connect(self, block: np.ndarray, candidates: np.ndarray) -> None:
        """New neighbours for the block, and edges back to it: of those, the nearest ``4 x degree`` are candidates beside the old ones."""
        own = self.near[:, : self.degree]
        own[block] = self.prune(block, candidates)
        src = np.repeat(block, self.degree)
        dst = own[block].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        far = self.sq[src] + self.sq[dst] - 2 * np.einsum("rd,rd->r", self.x[src], self.x[dst])
        by = np.lexsort((src, far, dst))
        src, dst = src[by], dst[by]
        nodes, first, counts = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 1024):
            part, lo, n_new = nodes[at : at + 1024], first[at : at + 1024], counts[at : at + 1024]
            width = int(min(n_new.max(), 4 * self.degree))
            cols = np.arange(width)
            new = np.where(cols < n_new[:, None], src[np.minimum(lo[:, None] + cols, len(src) - 1)], -1)
            own[part] = self.prune(part, np.hstack([own[part], new]))

    def reachable(self) -> np.ndarray:
        seen = np.zeros(len(self.x), bool)
        seen[self.entry] = True
        edge = np.array([self.entry])
        while len(edge):
            edge = np.unique(self.near[edge])
            edge = edge[edge >= 0]
            edge = edge[~seen[edge]]
            seen[edge] = True
        return seen

    def _reach_all(self) -> None:
        """An edge to each vector that no path reaches, from the nearest found one that has a spare place.

        Found vectors are reachable, and places that hold an edge keep it: one pass reaches all.
        """
        lost = np.flatnonzero(~self.reachable())
        for at in range(0, len(lost), 1024):
            block = lost[at : at + 1024]
            ids, _ = self.search(self.x[block], self.beam)
            for node, found in zip(block, ids, strict=True):
                free = self.near[found[found >= 0], self.degree :] < 0
                rows = np.flatnonzero(free.any(axis=1))
                if len(rows):
                    self.near[found[rows[0]], self.degree + int(free[rows[0]].argmax())] = node
                else:  # all found ones are full: one more place for every vector
                    self.near = np.hstack([self.near, np.full((len(self.x), 1), -1, np.int32)])
                    self.near[found[0], -1] = node

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse neighbours of each node out of its candidates (-1: none)."""
        cand = np.where(candidates == nodes[:, None], -1, candidates)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        for at in range(0, len(nodes), 128):
            c = cand[at : at + 128]
            v = self.x[c]
            own = self.x[nodes[at : at + 128]]
            far = self.sq[c] - 2 * np.einsum("bcd,bd->bc", v, own) + (own**2).sum(axis=1)[:, None]
            far[c < 0] = np.inf
            by = np.argsort(far, axis=1, kind="stable")[:, : max(1, int((c >= 0).sum(axis=1).max()))]  # all candidates
            c, far = np.take_along_axis(c, by, 1), np.take_along_axis(far, by, 1)
            v = self.x[c]
            between = self.sq[c][:, :, None] + self.sq[c][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
            alive, rows = np.isfinite(far), np.arange(len(c))
            for k in range(self.degree):
                best = np.where(alive, far, np.inf).argmin(axis=1)
                ok = alive[rows, best]
                if not ok.any():
                    break
                kept[at : at + 128][ok, k] = c[rows, best][ok]
                alive &= ~((self.alpha**2 * between[rows, best] <= far) & ok[:, None])
                alive[rows, best] = False
        return kept

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for a block of queries: ids (-1: none) and squared distances, nearest first."""
        b, n = len(queries), len(self.x)
        beam = min(beam, n)
        ids = np.full((b, beam), -1, np.int64)
        far = np.full((b, beam), np.inf, np.float32)
        opened = np.zeros((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)  # the last column is for empty places
        q2 = (queries**2).sum(axis=1)
        ids[:, 0] = self.entry
        far[:, 0] = self.sq[self.entry] - 2 * queries @ self.x[self.entry] + q2
        seen[:, self.entry] = True
        live = np.arange(b)
        while len(live):
            open_ = ~opened[live] & (ids[live] >= 0)
            live = live[open_.any(axis=1)]
            if not len(live):
                break
            at = (~opened[live] & (ids[live] >= 0)).argmax(axis=1)  # lists are sorted: the nearest unopened
            node = ids[live, at]
            opened[live, at] = True
            nb = self.near[node]
            fresh = (nb >= 0) & ~seen[live[:, None], nb]
            safe = np.where(nb >= 0, nb, 0)
            d = self.sq[safe] - 2 * np.einsum("brd,bd->br", self.x[safe], queries[live]) + q2[live][:, None]
            d = np.where(fresh, d, np.inf).astype(np.float32)
            seen[live[:, None], nb] = True
            all_far = np.hstack([far[live], d])
            by = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, by, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(fresh, nb, -1)]), by, 1)
            opened[live] = np.take_along_axis(np.hstack([opened[live], np.zeros(nb.shape, bool)]), by, 1)
            ids[live] = np.where(np.isfinite(far[live]), ids[live], -1)
        return ids, far


def unit(vector: np.ndarray) -> np.ndarray:
    """The vector at length 1, whatever the size of its components."""
    scaled = vector / np.abs(vector).max()
    return scaled / np.sqrt((scaled**2).sum())


def norm_band(vector: str) -> Column:
    """Number of the band of norms: the longest vector of a band is up to four times as long as the shortest, and 1 is near the middle of one."""
    most = F.array_max(F.transform(vector, lambda c: F.abs(c)))
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda a, c: a + F.pow(c / most, F.lit(2.0)))
    return F.floor((F.log2(most) + F.log2(squares) / 2) / 2 + F.lit(0.25)).cast("int")


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not all zero and has finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0))


GRAPH = "dim int, shard int, n int, entry int, vectors binary, near binary, counts binary, ids binary"


def build(placed: DataFrame, shards: int, beam: int = BEAM) -> DataFrame:
    """One row per shard of ``placed(dim, shard, v, ids)``: its graph, vectors and ids as bytes, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, ids = None, [], []

        def made() -> pa.RecordBatch:
            original = np.concatenate(base).reshape(-1, at[0])
            graph = Graph(original, beam=beam)
            counts = np.array([len(x) for x in ids], np.int32)
            values = (at[0], at[1], len(original), graph.entry, original.tobytes(), graph.near.tobytes(), counts.tobytes(), np.concatenate(ids).tobytes())
            kinds = (*[pa.int32()] * 4, *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[c.split()[0] for c in GRAPH.split(", ")])

        for batch in batches:
            for dim, shard, v, own in zip(*(batch.column(c) for c in ("dim", "shard", "v", "ids")), strict=True):
                if at != (dim.as_py(), shard.as_py()):
                    if base:
                        yield made()
                    at, base, ids = (dim.as_py(), shard.as_py()), [], []
                base.append(v.values.to_numpy())
                ids.append(own.values.to_numpy())
        if base:
            yield made()

    dealt = placed.repartition(max(8, 4 * shards), "dim", "shard").sortWithinPartitions("dim", "shard", "v")
    return stored(dealt.select("dim", "shard", "v", "ids").mapInArrow(run, GRAPH))


def nearest(
    queries: DataFrame, rows: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = BEAM, search: int = SEARCH, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each query, its own id left out.

    Equal vectors are one graph node that carries its ``k + 1`` smallest ids, which
    is exact because ties go to the smaller id.  Vectors are compared with those of
    their own length only.  Null ids take no part; a repeated id counts once, with
    its smallest vector.  Components may be of any size: graphs hold scaled vectors,
    and inner products beyond the largest double are infinite.  A shard of
 up to ``search`` vectors is searched through its
    graph as any other and gives exact results, since every vector is reachable;
    empty tables give no rows.
    """
    base = usable(rows, vector).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    smallest = Window.partitionBy("v").orderBy("id")
    nodes = base.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes.withColumn("dim", F.size("v")).withColumn("band", norm_band("v")))
    sizes = nodes.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n")).orderBy("dim", "band").collect()  # up to 1,100 bands a vector length
    spark, shards, plan = queries.sparkSession, {}, []
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, band, n in sizes:
        plan.append((dim, band, shards.get(dim, 0), -(-n // shard_rows)))
        shards[dim] = sum(plan[-1][2:])
    bands = spark.createDataFrame(plan, "dim int, band int, first int, count int")
    shard = F.col("first") + F.pmod(F.xxhash64("v"), F.col("count")).cast("int")
    placed = nodes.join(F.broadcast(bands), ["dim", "band"]).select("dim", shard.alias("shard"), "v", "ids")
    graphs = build(placed, sum(shards.values()), beam)
    asked = usable(queries, vector).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("query_id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))
    lengths = spark.createDataFrame(list(shards.items()), "dim int, shards int")
    asked = asked.withColumn("dim", F.size("v")).join(F.broadcast(lengths), "dim")  # a row a vector length
    whole = [F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("entry", "int"), ("vectors", "binary"), ("near", "binary"), ("counts", "binary"), ("ids", "binary"))]
    dealt = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(SPLITS)).cast("int").alias("split"), F.lit(1).alias("kind"), "query_id", "v", *whole)
    copies = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("split"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "n", "entry", "vectors", "near", "counts", "ids")
    tasks = max(8, 2 * SPLITS * sum(shards.values()))
    streams = copies.unionByName(dealt).repartition(tasks, "dim", "shard", "split").sortWithinPartitions("dim", "shard", "split", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, graph, original, ids, waiting = None, None, None, [], []

        def answer() -> pa.RecordBatch:
            q = np.array([unit(w[1]) for w in waiting])  # the order of inner products stays
            found, _ = graph.search(np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32), search)
            out = ([], [], [])
            for (own, vec), got in zip(waiting, found, strict=True):
                got = got[got >= 0]
                scores = (original[got] * vec).sum(axis=1)
                best = sorted(((-s, i) for s, g in zip(scores.tolist(), got, strict=True) for i in ids[g].tolist() if i != own))[:k]
                out[0].extend([own] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(-s for s, _ in best)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c: row.column(c)[0].as_py()  # noqa: E731, B023
                if at != (get("dim"), get("shard"), get("split")):
                    if waiting:
                        yield answer()
                    at, graph = (get("dim"), get("shard"), get("split")), None
                if get("kind") == 0:
                    original = np.frombuffer(get("vectors"), np.float64).reshape(get("n"), -1)
                    graph = Graph(original, beam=beam, near=np.frombuffer(get("near"), np.int32).reshape(get("n"), -1), entry=get("entry"))
                    ids = np.split(np.frombuffer(get("ids"), np.int64), np.cumsum(np.frombuffer(get("counts"), np.int32))[:-1])
                elif graph is not None:
                    waiting.append((get("query_id"), np.array(get("v"))))
                    if len(waiting) >= BLOCK:
                        yield answer()
        if waiting:
            yield answer()

    found = streams.mapInArrow(run, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
