"""Keys that earlier batches held, kept without an end: key tables in buckets with Bloom filters in front.

A key lies in one of ``BUCKETS`` folders.  Each bucket has filter blocks of 32,768
bits; all bits of a key lie in one block.  A batch looks its keys up in the filters,
reads only those folders of keys that the filters let through, and compares the keys
there in full, so a filter saves reading but decides nothing.

Keys and filters of a batch are a run of level 0.  ``FAN`` runs of a level become one
run of the next, so batch n reads at most ``FAN - 1`` runs a level and a key is written
once a level.  Runs are named by their numbers and replaced when a batch is repeated.
No later batch reads runs that were merged; ``drop_merged`` deletes them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.runtime import materialize

BUCKETS = 64
#: Runs of a level that are merged into one of the next.
FAN = 8
#: Bits of a filter block, fixed by the bitmap functions, and bits that a key sets.
BLOCK_BITS, PROBES = 32_768, 7
#: Keys in a block at ten bits a key, where about one new key in a hundred passes.
KEYS_A_BLOCK = 3_000


def blocks_for(expected: int) -> int:
    """Filter blocks a bucket for a table of so many keys; with more keys the filters let more through, the rows stay right."""
    return max(1, -(-expected // (BUCKETS * KEYS_A_BLOCK)))


def runs_before(number: int, fan: int = FAN) -> list[tuple[int, int]]:
    """``(level, run)`` that together hold the batches before ``number``: its digits to the base ``fan``."""
    out, level, rest = [], 0, number
    while rest:
        out += [(level, rest - 1 - i) for i in range(rest % fan)]
        level, rest = level + 1, rest // fan
    return out


def _placed(rows: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """``rows`` with the hash, bucket and filter block of their keys; null is a key like any other."""
    h = F.xxhash64(*keys)
    out = rows.withColumn("__h", h).withColumn("__bucket", F.pmod(h, F.lit(BUCKETS)).cast("int"))
    return out.withColumn("__block", F.pmod(F.shiftright(h, 8), F.lit(blocks)).cast("int"))


def _bits(keys: list[str]) -> Column:
    """The bits of a key within its block, as steps of an odd width from a start."""
    other = F.xxhash64(F.lit("filter"), *keys)  # independent of what chose the bucket and the block
    start, step = F.pmod(other, F.lit(BLOCK_BITS)), F.pmod(F.shiftright(other, 20), F.lit(BLOCK_BITS)).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(start + step * i, F.lit(BLOCK_BITS)) for i in range(PROBES)])


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    return F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(bit, F.lit(8)).cast("int")) == 1


def _key_columns(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def _read(spark: SparkSession, path: str, kind: str, runs: list[tuple[int, int]], schema: str) -> DataFrame:
    folders = [f"{path}/{kind}/level={level}/run={run}" for level, run in runs]
    own = spark.read.schema(schema).option("basePath", f"{path}/{kind}")
    return own.parquet(*folders) if folders else spark.createDataFrame([], schema)


def stored_keys(rows: DataFrame, path: str, number: int, keys: list[str], fan: int = FAN) -> DataFrame:
    """The keys of all batches before ``number``, with hash and bucket; a condition on the bucket bounds the folders that are read."""
    schema = f"{_key_columns(rows, keys)}, __h long, __bucket int"
    return _read(rows.sparkSession, path, "keys", runs_before(number, fan), schema)


def filters(spark: SparkSession, path: str, number: int, fan: int = FAN) -> DataFrame:
    """``__bucket, __block, bits``: one filter block each for all batches before ``number``."""
    rows = _read(spark, path, "filters", runs_before(number, fan), "__bucket int, __block int, bits binary")
    return rows.groupBy("__bucket", "__block").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))


def passing(rows: DataFrame, path: str, number: int, keys: list[str], expected: int, fan: int = FAN) -> DataFrame:
    """``rows`` with the place of their key and ``__maybe``: false only for keys that no batch before ``number`` held."""
    placed = _placed(rows, keys, blocks_for(expected)).withColumn("__at", _bits(keys))
    met = placed.join(filters(rows.sparkSession, path, number, fan), ["__bucket", "__block"], "left")
    all_set = reduce(and_, [_is_set(F.col("bits"), F.get("__at", F.lit(i))) for i in range(PROBES)])
    return met.withColumn("__maybe", F.coalesce(all_set, F.lit(False))).drop("bits", "__at")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by all columns that can be compared; partial aggregates, so a frequent key is no hot task."""
    comparable = [c for c in rows.columns if c not in order and rows.schema[c].dataType.typeName() not in ("map", "variant")]
    first = F.min_by(F.struct(*rows.columns), F.struct(*order, *comparable)).alias("__row")
    return rows.groupBy(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)]).agg(first).select("__row.*")


def unseen(rows: DataFrame, path: str, number: int, keys: list[str], order: list[str], expected: int = 1_000_000, fan: int = FAN) -> DataFrame:
    """The first row of each key that no batch before ``number`` held.

    ``expected`` is the number of keys that the filters are laid out for and must
    stay the same for a table.  Keys may be several columns; null equals null.  Of
    repeated keys in the batch the first by ``order`` counts.  Columns are kept; no
    rows give no rows.
    """
    first = first_of_each(rows, keys, order)
    if not number:
        return materialize(first)
    met = materialize(passing(first, path, number, keys, expected, fan))
    buckets = [r[0] for r in met.where("__maybe").select("__bucket").distinct().collect()]  # at most BUCKETS numbers
    known = stored_keys(rows, path, number, keys, fan).where(F.col("__bucket").isin(buckets)).alias("k")
    same = reduce(and_, [F.col(f"m.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], F.col("m.__h") == F.col("k.__h"))
    left = met.where("__maybe").alias("m").join(known, same, "left_anti")
    return materialize(met.where("not __maybe").select(*rows.columns).unionByName(left.select(*rows.columns)))


def remember(rows: DataFrame, path: str, number: int, keys: list[str], expected: int = 1_000_000, fan: int = FAN) -> None:
    """Store the keys of ``rows`` (one row a key, as ``unseen`` gives them) as run ``number``, and merge what is full by then."""
    spark = rows.sparkSession
    placed = _placed(rows.select(*keys), keys, blocks_for(expected))
    _write_keys(placed.select(*keys, "__h", "__bucket"), f"{path}/keys/level=0/run={number}")
    bits = placed.select("__bucket", "__block", F.explode(_bits(keys)).alias("__bit"))
    built = bits.groupBy("__bucket", "__block").agg(F.call_function("bitmap_construct_agg", F.col("__bit")).alias("bits"))
    built.write.mode("overwrite").parquet(f"{path}/filters/level=0/run={number}")
    level, run = 0, number
    while (run + 1) % fan == 0:
        merged = [(level, run - i) for i in range(fan)]
        level, run = level + 1, run // fan
        whole = _read(spark, path, "keys", merged, f"{_key_columns(rows, keys)}, __h long, __bucket int")
        _write_keys(whole, f"{path}/keys/level={level}/run={run}")
        parts = _read(spark, path, "filters", merged, "__bucket int, __block int, bits binary")
        ored = parts.groupBy("__bucket", "__block").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
        ored.write.mode("overwrite").parquet(f"{path}/filters/level={level}/run={run}")


def _write_keys(rows: DataFrame, folder: str) -> None:
    """Ranges of bucket and hash, so that a large bucket is written by several tasks and a small run in few files."""
    rows.repartitionByRange("__bucket", "__h").sortWithinPartitions("__bucket", "__h").write.mode("overwrite").partitionBy("__bucket").parquet(folder)


def admit_new(batch: DataFrame, number: int, path: str, keys: list[str], order: list[str], expected: int = 1_000_000, fan: int = FAN) -> DataFrame:
    """Insert-if-absent over a stream: the ``unseen`` rows of a batch, whose keys are remembered from then on; a repeated batch gives the same rows."""
    new = unseen(batch, path, number, keys, order, expected, fan)
    remember(new, path, number, keys, expected, fan)
    return new


def drop_merged(spark: SparkSession, path: str, number: int, fan: int = FAN) -> int:
    """Delete the runs that neither batch ``number``, should it be repeated, nor a later one reads; the number of folders deleted."""
    kept = {f"level={level}/run={run}" for n in (number, number + 1) for level, run in runs_before(n, fan)}
    gone = 0
    for kind in ("keys", "filters"):
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/level=*/run=*")
        files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(pattern):
            folder = found.getPath()
            if f"{folder.getParent().getName()}/{folder.getName()}" not in kept:
                gone += files.delete(folder, True)
    return gone
