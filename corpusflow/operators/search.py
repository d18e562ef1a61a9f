"""Substring search through a stored trigram index.

The index is a table of postings ``gram, ids``, in folders by batch and by bucket of
the gram, sorted by gram, so that a search lists and reads the folders of its own
grams only.  A gram has a row for each batch of texts that holds it.  The index may name rows that no longer hold a gram, never misses one that
does: what it finds is compared with the pattern in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.runtime import text_batches

GRAM = 3
#: Folders of an index; a gram lies in one of them.
BUCKETS = 256
#: Ids of a list ascend and are stored by their differences, in a tenth of the time that a dictionary of them takes.
ENCODING = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
#: Grams of a pattern that are intersected, the rarest ones; the others would hardly cut down what these leave.
RAREST = 4
#: Bits of the map of found ids that is broadcast, 64 to a row of it.
MAP_BITS = 1 << 26
#: Bytes of text whose grams are sorted at once; a longer text is taken on its own.
SLICE_BYTES = 8_000_000
#: Stretches of three characters that an alphabet may have for a table of all of them (16 MB); with more, texts keep those that come again until they are sorted.
GRAMS_AT_HAND = 1 << 21


def _strings(points: np.ndarray) -> pa.Array:
    """The strings whose code points are the rows of ``points``."""
    flat = points.astype("<u4").ravel()
    width = (1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)).reshape(points.shape).sum(axis=1)
    data = flat.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(np.r_[0, np.cumsum(width)].astype(np.int32)), pa.py_buffer(data))


def _points(text: pa.Scalar) -> np.ndarray:
    return np.frombuffer(text.as_buffer().to_pybytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _held(ids: pa.Array, columns: list[pa.Array]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The distinct stretches of three characters of a slice of rows, each with the list of the rows that hold it.

    The stretches of a text are numbered and those that come again dropped text by text,
    within the caches of a core; only what is left is sorted.
    """
    texts = [(row, points) for c in columns for row, v in enumerate(c) if v.is_valid and len(points := _points(v)) >= GRAM]
    if not texts:
        return
    used = np.zeros(max(int(p.max()) for _, p in texts) + 1, bool)
    for _, points in texts:
        used[points] = True
    alphabet = np.flatnonzero(used)
    n, k = len(ids), len(alphabet)
    if n > 1 and n * k**GRAM >= 2**63:  # numbers of gram and row would not fit
        for low, high in ((0, n // 2), (n // 2, n)):
            yield from _held(ids.slice(low, high - low), [c.slice(low, high - low) for c in columns])
        return
    place = np.zeros(len(used), np.int64)
    place[alphabet] = np.arange(k)
    places = np.arange(max(len(p) for _, p in texts))
    last = np.empty(k**GRAM if k**GRAM <= GRAMS_AT_HAND else 0, np.int64)  # where a stretch was met last
    own = []
    for row, points in texts:
        of = place.take(points)
        gram = of[:-2] * k
        gram += of[1:-1]
        gram *= k
        gram += of[2:]
        if len(last):
            at = places[: len(gram)]
            last[gram] = at
            gram = gram[last.take(gram) == at]
        gram *= n
        gram += row
        own.append(gram)
    pairs = np.sort(np.concatenate(own))
    del texts, own
    first = np.ones(len(pairs), bool)
    np.not_equal(pairs[1:], pairs[:-1], out=first[1:])
    pairs = pairs[first]
    gram = pairs // n
    row = pairs - gram * n
    begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    own = gram[begins]
    yield _strings(alphabet[np.stack([own // (k * k), own // k % k, own % k], axis=1)]), pa.ListArray.from_arrays(pa.array(np.r_[begins, len(row)].astype(np.int32)), ids.take(pa.array(row)))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts exceed ``SLICE_BYTES``."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns[1:]:
        size += pa.compute.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES)) + 1
    for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
        yield batch.slice(low, high - low)


def postings(rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``gram, ids``: the stretches of three characters of the columns in lower case, a row for each slice of texts; null and shorter texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                for gram, ids in _held(piece.column(0), piece.columns[1:]):
                    yield pa.RecordBatch.from_arrays([gram, ids], ["gram", "ids"])

    text_batches(rows.sparkSession)
    lower = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[F.lower(F.col(c)).alias(f"text_{i}") for i, c in enumerate(columns)])
    return lower.mapInArrow(run, f"gram string, ids array<{rows.schema[key].dataType.simpleString()}>")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def add_to_index(rows: DataFrame, path: str, columns: list[str], batch: int = 0, key: str = "id") -> None:
    """Index the texts of ``columns`` under batch number ``batch``; indexing a batch again replaces it.

    A row that changes is added again with a later batch.  Rows with a null key are
    left out.  Postings are dealt by bucket; adaptive execution splits large buckets,
    so a gram that nearly every row holds is written by many tasks.
    """
    found = postings(rows, columns, key).withColumn("bucket", _bucket(F.col("gram"))).hint("rebalance", "bucket")
    found.sortWithinPartitions("bucket", "gram").write.options(**ENCODING).mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def literals(pattern: str) -> list[str]:
    """What stands between the ``%`` and ``_`` of a LIKE pattern; a backslash takes the next sign as it is."""
    out, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            out.append("")
        else:
            if c == "\\" and at + 1 < len(pattern):
                at += 1
                c = pattern[at]
            out[-1] += c
        at += 1
    return [piece for piece in out if piece]


def _wanted(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """The grams that every text of the pattern holds, each with its bucket, in lower case as Spark's LIKE has it."""
    lower = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    names = sorted({piece[i : i + GRAM] for piece in literals(lower) for i in range(len(piece) - GRAM + 1)})
    if not names:
        return []
    return [tuple(r) for r in spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("gram")).select("gram", _bucket(F.col("gram"))).collect()]  # as many as the pattern is long


def _postings(stored: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    buckets, names = sorted({b for _, b in wanted}), [n for n, _ in wanted]
    return stored.where(F.col("bucket").isin(buckets) & F.col("gram").isin(names))


def candidates(rows: DataFrame, path: str, pattern: str, key: str = "id") -> DataFrame | None:
    """``id`` of those rows that hold the rarest grams of a LIKE pattern in any case, or None if it has no literal of three characters."""
    wanted = _wanted(rows.sparkSession, pattern)
    if not wanted:
        return None
    stored = rows.sparkSession.read.schema(f"gram string, ids array<{rows.schema[key].dataType.simpleString()}>, batch int, bucket int").parquet(path)
    counts = {r.gram: r.n for r in _postings(stored, wanted).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}  # as many as the pattern is long
    rarest = sorted(wanted, key=lambda g: (counts.get(g[0], 0), g[0]))[:RAREST]
    bit = F.coalesce(*[F.when(F.col("gram") == name, 1 << i) for i, (name, _) in enumerate(rarest)])
    together = _postings(stored, rarest).select(F.explode("ids").alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    return together.where(F.col("bits") == (1 << len(rarest)) - 1).select("id")


def _place(key: Column) -> tuple[Column, Column]:
    """The row of an id in the map of found ids and its bit there."""
    place = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def narrowed(rows: DataFrame, path: str, pattern: str, key: str = "id") -> DataFrame:
    """The rows that the index does not rule out for a LIKE pattern; all rows, if the pattern has no literal of three characters.

    The ids found are marked in a map of ``MAP_BITS`` bits, a row for each 64 of them, which
    is broadcast whatever their number, so that no text is shuffled or sorted.  A few other
    ids share their bits: one in 30 of two million, one in four of twenty million.
    """
    ids = candidates(rows, path, pattern, key)
    if ids is None:
        return rows
    word, bit = _place(F.col("id"))
    found = ids.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    word, bit = _place(F.col(key))
    return rows.join(F.broadcast(found), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi")


def like(rows: DataFrame, path: str, pattern: str, columns: list[str], key: str = "id") -> DataFrame:
    """The rows of which one of the indexed ``columns`` matches a LIKE pattern in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return narrowed(rows, path, pattern, key).where(hit)
