"""Exact ranked lexical search through sparse ball trees.

A document is the sparse vector of its saturated term frequencies, an item that of
its term weights, and the score their inner product.  Tasks take documents in
blocks, build a ball tree over each (centroid and radius of every subtree) and
search it best-first for every item: a subtree whose centroid score plus radius
times the item's norm stays under the item's k-th best score so far holds no better
document.  In so many dimensions most of a radius lies in terms that an item lacks,
so a ball also has a radius along each coordinate, and the smaller bound counts.
Bounds are doubles rounded up; leaves are scored in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.runtime import partition_prefix_sums, stored

#: Bytes of item text whose terms are held at a time; more items are searched group by group.
GROUP_BYTES = 512 * 1024
BLOCK_DOCS = 2_048
BLOCK_TERMS = 262_144
LEAF = 32
SKETCH = 16
#: Bounds are raised by this share, far above what double rounding can take away.
SLACK = 1e-9
#: Separators become spaces, A-Z small letters; bytes of other scripts stay.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
LAST_ID = 2**63


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def _counter(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a document's terms: all of them in ``n``, those of the broadcast vocabulary one by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            n, found, tf = [], [], []
            for text in batch.column("text"):
                words = terms(text.as_py())
                known = {number[w]: c for w, c in Counter(words).items() if w in number}
                n.append(len(words))
                found.append(list(known))
                tf.append(list(known.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return count


class BallTree:
    """A ball tree over sparse rows of integers, in coordinates scaled by ``scale``.

    ``start`` gives the first posting of each row; postings are ``term, value`` with
    terms sorted within a row.  The tree is complete: its ``2 ** depth`` leaves hold
    rows in the order ``rows``; node 1 is the root, 2 i and 2 i + 1 are the children of i.
    """

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray, leaf: int = LEAF):
        n = len(start) - 1
        owner = np.repeat(np.arange(n), np.diff(start))
        self.terms, column = np.unique(term, return_inverse=True)
        scaled = value * scale[term]
        depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
        self.leaves = 1 << depth
        self.rows, self.cuts = self._split(n, owner, term, scaled, depth)
        place = np.empty(n, np.int64)  # leaf of each row
        place[self.rows] = np.repeat(np.arange(self.leaves), np.diff(self.cuts))
        width = len(self.terms)
        self.centroid = np.zeros((2 * self.leaves, width))
        self.centroid[self.leaves :] = np.bincount(place[owner] * width + column, scaled, self.leaves * width).reshape(self.leaves, width)
        size = np.zeros(2 * self.leaves)
        size[self.leaves :] = np.diff(self.cuts)
        for i in range(self.leaves - 1, 0, -1):
            self.centroid[i] = self.centroid[2 * i] + self.centroid[2 * i + 1]
            size[i] = size[2 * i] + size[2 * i + 1]
        self.centroid /= np.maximum(size, 1)[:, None]
        square = (self.centroid**2).sum(1)
        own = np.bincount(owner, scaled**2, n)
        self.radius = np.zeros(2 * self.leaves)
        node = place + self.leaves
        while True:
            across = np.bincount(owner, scaled * self.centroid[node[owner], column], n)
            far = own - 2 * across + square[node] + SLACK * (own + square[node])  # the slack covers what cancels
            np.maximum.at(self.radius, node, np.sqrt(np.maximum(far, 0)))
            if node[0] == 1:
                break
            node = node >> 1
        self.reach = np.zeros((2 * self.leaves, width))  # centroid plus radius, coordinate by coordinate
        np.maximum.at(self.reach, (place[owner] + self.leaves, column), scaled)
        for i in range(self.leaves - 1, 0, -1):
            np.maximum(self.reach[2 * i], self.reach[2 * i + 1], out=self.reach[i])
        self.empty = size == 0
        self._parts = (start, column, value)
        self._leaf: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _split(n: int, owner: np.ndarray, term: np.ndarray, scaled: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in leaf order and the cuts between leaves: halves between two distant rows, seen through a random projection."""
        sketch = np.empty((n, SKETCH))
        for d in range(SKETCH):
            sign = ((term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20 + d)) & np.uint64(1)).astype(float) * 2 - 1
            sketch[:, d] = np.bincount(owner, scaled * sign, n)
        groups = [np.arange(n)]
        for _ in range(depth):
            halves = []
            for rows in groups:
                if len(rows) > 1:
                    x = sketch[rows]
                    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
                    b = x[((x - a) ** 2).sum(1).argmax()]
                    rows = rows[np.argsort(x @ (b - a), kind="stable")]
                halves += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            groups = halves
        return np.concatenate(groups), np.concatenate(([0], np.cumsum([len(g) for g in groups])))

    def leaf(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a leaf, its columns sorted, and its values as a dense matrix over them."""
        rows = self.rows[self.cuts[i] : self.cuts[i + 1]]
        if i not in self._leaf:
            start, column, value = self._parts
            at = np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])
            local = np.repeat(np.arange(len(rows)), start[rows + 1] - start[rows])
            columns, inverse = np.unique(column[at], return_inverse=True)
            dense = np.zeros((len(columns) + 1, len(rows)), np.int64)  # the last line stands for terms that no row has
            dense[inverse, local] = value[at]
            self._leaf[i] = columns, dense
        return rows, *self._leaf[i]

    def search(self, term: np.ndarray, weight: np.ndarray, scale: np.ndarray, best: list[tuple[int, int]], k: int, ids: list[int]) -> int:
        """Put the best rows for an item into the heap ``best`` of ``(score, -id)``; returns how many leaves were scored."""
        at = np.searchsorted(self.terms, term)
        known = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == term)
        if not known.any():
            return 0
        column, weight = at[known], weight[known]
        query = weight / scale[term[known]]
        ball = self.centroid[:, column] @ query + math.sqrt(float(query @ query)) * self.radius
        bound = np.minimum(ball, self.reach[:, column] @ query) * (1 + SLACK) + 1
        least = lambda: best[0][0] if len(best) == k else 1
        queue, scored = [(-bound[1], 1)], 0
        while queue and -queue[0][0] >= least():
            node = heapq.heappop(queue)[1]
            if node < self.leaves:
                for child in (2 * node, 2 * node + 1):
                    if bound[child] >= least() and not self.empty[child]:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            rows, columns, dense = self.leaf(node - self.leaves)
            scored += 1
            line = np.searchsorted(columns, column)
            line[(line == len(columns)) | (columns[np.minimum(line, len(columns) - 1)] != column)] = len(columns)
            scores = weight @ dense[line]
            for r in np.flatnonzero(scores >= least()):
                entry = (int(scores[r]), -ids[rows[r]])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _searcher(shared, k: int, block_docs: int, block_terms: int, leaf: int):
    """Searches the documents of a partition block by block, keeping the best ``k`` of each item from block to block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tf")], strict=True):
                held.append(row)
                size += len(row[2])
                if len(held) == block_docs or size >= block_terms:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, scale, documents, length = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        scored = 0
        for held in blocks(batches):
            ids = [LAST_ID if row[0] is None else row[0] for row in held]
            start = np.concatenate(([0], np.cumsum([len(row[2]) for row in held])))
            term = np.concatenate([np.array(row[2], np.int64) for row in held])
            tf = np.concatenate([np.array(row[3], np.int64) for row in held])
            norm = np.array([25 + 75 * row[1] * documents // length for row in held], np.int64)
            value = 1_000_000_000 * tf // (1_000 * tf + 8 * np.repeat(norm, np.diff(start)))
            tree = BallTree(start, term, value, scale, leaf)
            for heap, (_, own, weight) in zip(best, items, strict=True):
                scored += tree.search(own, weight, scale, heap, k, ids)
        rows = [(i, -d if -d < LAST_ID else None, s) for i, heap in enumerate(best) for s, d in heap]
        arrays = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score"])

    return search


def _weights(counts: DataFrame, documents: int) -> dict[int, int]:
    """The weight of each vocabulary term that a document holds: at most as many rows as the vocabulary has terms."""
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    return {r.term: math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))) for r in held}


def _search_group(docs: DataFrame, items: list[tuple], k: int, block_docs: int, block_terms: int, leaf: int) -> DataFrame:
    spark = docs.sparkSession
    wanted = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in wanted for t in c}))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counter(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tf array<long>")
    counts = stored(counts)
    sums = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    weight = _weights(counts, sums.documents)
    scale = np.ones(max(len(vocabulary), 1))
    for t, w in weight.items():
        scale[t] = math.sqrt(max(w, 1))
    asked = []
    for (item, _), counted in zip(items, wanted, strict=True):
        own = sorted((vocabulary[t], n * weight[vocabulary[t]]) for t, n in counted.items() if weight.get(vocabulary[t], 0) > 0)
        asked.append((item, np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    shared = spark.sparkContext.broadcast((asked, scale, sums.documents, max(sums.length, 1)))
    found = counts.where(F.size("terms") > 0).mapInArrow(_searcher(shared, k, block_docs, block_terms, leaf), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # each map task passes on k rows an item
    names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item int, item_id long"))  # the group's items
    return top.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, group_bytes: int = GROUP_BYTES, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS, leaf: int = LEAF) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest positive score for each row of ``items``.

    With N documents that hold a term, L terms in all of them and df documents that
    hold a term, the term weighs ``floor(1000 ln((2 N + 2) / (2 df + 1)))``.  A document
    of n terms has ``m = 25 + (75 n N) div L`` and scores, summed over the item's terms
    with repeats, weight times ``(1e9 tf) div (1000 tf + 8 m)``.  Equal scores rank by
    ascending ``doc_id``, null last.

    Null and empty texts, of documents and items, hold no terms: such items give no
    rows, such documents count for nothing.  Each row is a document, or an item, of
    its own, repeated rows too.  Other columns are ignored; empty tables give no rows.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    size = F.octet_length("text").cast("long")
    placed = stored(partition_prefix_sums(asked, [F.col("item_id"), F.col("text")], {"upto": size}).withColumn("part", F.floor((F.col("upto") - size) / group_bytes)))
    results = []
    for part in sorted(r.part for r in placed.select("part").distinct().collect()):  # a number per ``group_bytes`` of items
        group = [(r.item_id, r.text) for r in placed.where(F.col("part") == part).orderBy("upto").collect()]  # bounded by ``group_bytes`` and one item
        results.append(_search_group(docs, group, k, block_docs, block_terms, leaf))
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
