"""SimHash near-duplicates through a segment-popcount embedding.

Sixteen 4-bit segments of a 64-bit fingerprint give a vector of bit counts.  The
Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so fingerprints within 2 bits lie within distance 2 on the grid and
share at least one grid cell at distance 1 or less from both.  Cells held by one
fingerprint alone are dropped; in the others the link is verified exactly: two
fingerprints differ in at most 2 bits if and only if some word lies within 1 bit
of both, and that word's bit counts are a shared cell.  At most 65 fingerprints
lie within one bit of a word, so no group is unbounded and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.operators.components import connected_components
from corpusflow.runtime import materialize, stored, text_batches

SEGMENTS, WIDTH = 16, 4
BLOCK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 values (seed 42) of the word shingles, repeats included, in bounded blocks; nothing without words.

    ASCII letters are lower-cased; words are runs without ASCII white space; a
    text of fewer words is one shingle.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    flat = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    k, digest = min(words, len(tokens)), xxhash.xxh64_intdigest
    n = len(tokens) - k + 1
    for at in range(0, n, BLOCK):
        upto = min(n, at + BLOCK)
        yield np.array([digest(flat[s:e], 42) for s, e in zip(starts[at:upto], ends[at + k - 1 : upto + k - 1], strict=True)], "<u8")


def majority(blocks: list[np.ndarray]) -> int:
    """The word whose bits are set in over half of the values; 0 without values."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority vote of the hashes of the word shingles; 0 without words."""
    return majority(list(shingle_hashes(text, words)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the 64-bit fingerprint as a signed long.  Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    text_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def grid_cells(fps: DataFrame) -> DataFrame:
    """Each fingerprint's grid cells at Manhattan distance 1 or less: ``(fp, cell, segment, step)``."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))).cast("long") for i in range(SEGMENTS)]
    base = WIDTH + 1
    coded = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    code = sum((F.col(f"c{i}") * F.lit(base**i) for i in range(1, SEGMENTS)), F.col("c0"))
    coded = coded.withColumn("code", code)

    def cell(at: int, step: int):
        ok = (F.col(f"c{at}") < WIDTH) if step > 0 else (F.col(f"c{at}") > 0)
        made = F.struct(
            (F.col("code") + F.lit(step * base**at)).alias("cell"),
            F.lit(at).cast("byte").alias("segment"),
            F.lit(step).cast("byte").alias("step"),
        )
        return F.when(ok, made)

    own = F.struct(F.col("code").alias("cell"), F.lit(0).cast("byte").alias("segment"), F.lit(0).cast("byte").alias("step"))
    ball = F.array(own, *[cell(i, s) for i in range(SEGMENTS) for s in (1, -1)])
    return coded.select("fp", F.explode(F.array_compact(ball)).alias("g")).select("fp", "g.*")


def links(fps: DataFrame) -> DataFrame:
    """Star links ``(a, b)`` that connect exactly the fingerprints within 2 bits of each other.

    ``fps`` holds distinct non-null fingerprints.
    """
    cells = grid_cells(fps)
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    near = cells.join(shared, "cell", "left_semi")
    bits = [F.expr(f"shiftleft(1L, segment * {WIDTH} + {j})") for j in range(WIDTH)]
    flips = F.array(*[F.when((F.col("fp").bitwiseAND(b) == 0) == (F.col("step") > 0), F.col("fp").bitwiseXOR(b)) for b in bits])
    words = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.array_compact(flips))
    within = near.select("fp", F.explode(words).alias("word"))
    least = F.min("fp").over(Window.partitionBy("word"))  # at most 65 rows a word
    return within.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents linked, directly or through others, at 2 bits or fewer.

    ``component_id`` is the smallest ``doc_id`` reachable, the row's own included.
    Null and blank texts have fingerprint 0 and are linked like any other; rows
    with a null ``doc_id`` are kept, take part, and never name a component unless
    all of it is null; repeated rows stay repeated; an empty table gives no rows.
    Columns besides ``doc_id`` and ``text`` are ignored.
    """
    found = materialize(fingerprints(docs, words))
    fps = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    parts = materialize(connected_components(links(fps.select("fp"))).withColumnRenamed("node", "fp"))
    least = parts.join(fps, "fp").groupBy("component").agg(F.min("least_id").alias("part_id"))
    named = parts.join(least, "component").select("fp", "part_id", F.lit(True).alias("in_part"))
    ids = fps.join(named, "fp", "left").select("fp", F.when(F.col("in_part"), F.col("part_id")).otherwise(F.col("least_id")).alias("component_id"))
    return found.join(materialize(ids), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


BANDS, SAMPLE = 10, 3
_MIX = np.random.default_rng(6).integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band: a hash of the ``SAMPLE`` shingles that are smallest under the band's own mixing."""
    out = []
    for mix in _MIX:
        v = (hashes ^ (hashes >> np.uint64(31))) * mix
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.sort(np.partition(v, SAMPLE - 1)[:SAMPLE] if len(v) > SAMPLE else v)
        out.append(xxhash.xxh64_intdigest(low.tobytes()) - (1 << 63))
    return out


def alike(a: str | None, b: str | None, words: int, least: float) -> bool:
    """Whether the Jaccard similarity of the two sets of shingles is ``least`` or more."""
    x, y = (set(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(t, words)]).tolist()) for t in (a, b))
    common = len(x & y)
    return common >= least * (len(x) + len(y) - common)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words)]))


def parity(hashes: np.ndarray) -> bytes:
    """Bits, two to four a shingle: each says whether an odd number of the shingles falls on it."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets holds, from their parities; the longer one is folded."""
    short, long = sorted((a, b), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(folded ^ np.frombuffer(short, np.uint8)).sum())


#: Bits of the map that ``marked`` broadcasts, and bits of one of its rows (those of ``bitmap_construct_agg``).
MAP_BITS, ROW_BITS = 1 << 23, 1 << 15


def _place(on: list[str]) -> tuple:
    """The row and the bit of the map that the ``on`` columns hash to."""
    place = F.pmod(F.xxhash64(*on), F.lit(MAP_BITS))
    return F.floor(place / ROW_BITS).cast("int"), place % ROW_BITS


def key_map(keys: DataFrame, on: list[str]) -> DataFrame:
    """``(__part, __bits)``: a map of ``MAP_BITS`` bits, 1 MB at most whatever the number of keys, in which those of all keys are set."""
    part, bit = _place(on)
    return keys.groupBy(part.alias("__part")).agg(F.bitmap_construct_agg(bit).alias("__bits"))


def marked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``__maybe``, which is true where the ``on`` columns hash to the place of some row of ``keys``: a filter before a join.

    No match is lost; with more keys more other rows pass.
    """
    part, bit = _place(on)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumns({"__part": part, "__bit": bit}).join(F.broadcast(key_map(keys, on)), "__part", "left")
    return placed.withColumn("__maybe", F.coalesce(F.getbit(byte, F.col("__bit") % 8) == 1, F.lit(False))).drop("__part", "__bit", "__bits")


def verified(rows: DataFrame, sketches: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole texts have similarity ``least`` or more.

    Pairs whose parities already differ in too many bits are dropped first, so few texts are moved.
    """
    thin = lambda side: sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"p_{side}"))
    sized = pairs.join(thin("a"), "a").join(thin("b"), "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least - 1e-9))
    most = (1 - least) / (1 + least)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = [least_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(differ, float) <= most * n + 1e-6))

    near = materialize(sized.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(close, "a long, b long"))
    needed = sketches.select("node", "id", "digest").join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    needed = materialize(needed)
    some = marked(rows, needed, ["id", "digest"]).where("__maybe").select(F.col("id").alias("id_"), F.col("digest").alias("digest_"), "text")
    texts = some.join(needed, F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))).groupBy("node").agg(F.min("text").alias("text"))
    left = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([alike(x.as_py(), y.as_py(), words, least) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


#: Hubs of a band key, and hubs of its band keys that a document is compared with.
HUBS, NEAREST_HUBS = 3, 6


def similar_links(rows: DataFrame, sketches: DataFrame, words: int, least: float) -> DataFrame:
    """Links ``(a, b)`` of similarity ``least`` or more between a document and hubs of its band keys.

    The hubs of a key are the documents that share their keys with the most others,
    as the original of a group of edited copies does.  A document meets the
    ``NEAREST_HUBS`` that it shares most keys with.  That joins most near copies at
    a cost in proportion to the documents; ``prefix_links`` finds every pair that
    is left.
    """
    keyed = sketches.select("node", "fp", F.posexplode("keys").alias("band", "key"))
    held = materialize(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = materialize(keyed.join(held, ["band", "key"]))
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    top = Window.partitionBy("band", "key").orderBy(F.col("weight").desc(), "node")
    ranked = shared.join(weights, "node").withColumn("place", F.row_number().over(top)).where(F.col("place") <= HUBS)
    hubs = ranked.select("band", "key", F.col("node").alias("other"), F.col("fp").alias("other_fp"))
    met = shared.join(hubs, ["band", "key"]).where("node <> other and fp <> other_fp")
    common = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("keys"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("keys")).alias("by"), "other"))), 1, NEAREST_HUBS)  # of HUBS a band at most
    near = common.groupBy("node").agg(best.alias("best")).select("node", F.explode("best.other").alias("other"))
    pairs = materialize(near.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct())
    return verified(rows, sketches, pairs, words, least)


HOT_DOCS, HOT_SEEN, HOT_MOST = 20_000, 20, 100_000


def hot_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that ``HOT_SEEN`` or more of about ``HOT_DOCS`` documents hold, and how many hold them.

    Of more than ``HOT_MOST`` the more frequent ones.  They only order the
    shingles of a set; any order finds the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words).view(np.int64))], names=["key"])

    step = max(1, -(-rows.count() // HOT_DOCS))
    some = rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(step)) == 0).select("text")
    found = materialize(some.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_SEEN))
    least, kept = float("inf"), 0
    for n, held in sorted(found.groupBy("n").count().collect(), reverse=True):  # n is bounded by the sample
        kept += held
        if kept > HOT_MOST:
            break
        least = n
    found = found.where(F.col("n") >= F.lit(least)).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


def rare_prefix(hashes: np.ndarray, hot: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which a set of similarity ``least`` must hold one in its own prefix."""
    n = len(hashes)
    size = n - int(np.ceil(least * n - 1e-9)) + 1
    keys, seen = hot
    count = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        count = np.where(keys[at] == hashes, seen[at], 0)
    return hashes[np.lexsort((hashes, count))[:size]]


def prefix_links(rows: DataFrame, sketches: DataFrame, parts: DataFrame, words: int, least: float) -> DataFrame:
    """All links ``(a, b)`` of similarity ``least`` or more between documents of different parts; ``parts(node, component)`` lacks single ones.

    Exact: with shingles in any one order, sets of that similarity share a shingle
    of both prefixes (``rare_prefix``), and the first one they share leaves room
    for the overlap they need.  Keys that one document holds are dropped by a
    count; the others meet the parts, and only keys of two parts are joined, a
    key's largest part not with itself.
    """
    keyed = sketches.select("node", F.posexplode("prefix").alias("at", "key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1").select("key"))
    met = materialize(keyed.join(shared, "key"))
    sized = parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component")
    known = sketches.select("node", "n").join(sized, "node", "left")
    held = materialize(met.join(known, "node").select("key", "node", "at", "n", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("component", "node").alias("part")))
    largest = held.groupBy("key").agg(F.max(F.struct("members", "part"))["part"].alias("largest"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    x, y = held.join(materialize(largest.where("lo <> hi").select("key", "largest")), "key").where("part <> largest").alias("x"), held.alias("y")
    need = (F.col("x.n") + F.col("y.n")) * F.lit(least / (1 + least)) - 1e-6
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & (room >= need))
    pairs = materialize(found.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct())
    return verified(rows, sketches, pairs, words, least)


def sketch(rows: DataFrame, words: int, least: float) -> DataFrame:
    """``node, id, digest, fp, n, keys, parity, prefix`` of every row, written to the shared folder; the texts are read once."""
    text_batches(rows.sparkSession)
    hot = rows.sparkSession.sparkContext.broadcast(hot_shingles(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for t in batch.column(2):
                blocks = list(shingle_hashes(t.as_py(), words))
                own = np.unique(np.concatenate([np.zeros(0, "<u8"), *blocks]))
                full = len(own) > 0
                out.append((majority(blocks), len(own), band_keys(own) if full else [], parity(own), rare_prefix(own, hot.value, least).view(np.int64) if full else []))
            fp, n, keys, odd, prefix = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(keys, longs), pa.array(odd, pa.binary()), pa.array(prefix, longs)],
                names=["id", "digest", "fp", "n", "keys", "parity", "prefix"],
            )

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, fp long, n int, keys array<long>, parity binary, prefix array<long>")
    return stored(made.withColumn("node", F.monotonically_increasing_id()))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one document, the smallest ``doc_id``, of each group of near copies.

    Documents are linked if their fingerprints differ in 2 bits or fewer, and,
    since texts of similarity 0.8 differ in 4 to 18 bits, also if their whole texts
    have similarity ``least``; every such pair that is not yet linked through
    others is found by an exact prefix join.
    A row is told apart by its ``doc_id`` and the digest of its text, and of rows
    equal in both one stays; ``doc_id`` and then the digest decide which of a group
    is the smallest.  A null ``doc_id`` loses to any other; ids may be of any type
    that has an order.  Null and blank texts are near copies of each other; an empty
    table gives no rows.  Columns are unchanged.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), text.alias("text"))
    sketches = sketch(rows, words, least)
    first = materialize(sketches.groupBy("fp").agg(F.min("node").alias("b")))
    own = sketches.join(first, "fp").select(F.col("node").alias("a"), "b").where("a <> b")
    fp_links = links(first.select("fp"))
    lo, hi = first.select(F.col("fp").alias("a"), F.col("b").alias("na")), first.select(F.col("fp").alias("b"), F.col("b").alias("nb"))
    near = fp_links.join(lo, "a").join(hi, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    edges = materialize(own.unionByName(near).unionByName(similar_links(rows, sketches, words, least)))
    parts = materialize(connected_components(edges))
    edges = edges.unionByName(prefix_links(rows, sketches, parts, words, least))
    groups = sketches.select("node", "id", "digest").join(materialize(connected_components(edges)), "node")
    smallest = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("stays"))
    other = ~(F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("digest") == F.col("stays.digest")))
    gone = materialize(groups.join(smallest, "component").where(other).select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    told = marked(docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), digest.alias("__digest")), gone, ["__id", "__digest"])
    told = told.select("__row.*", F.col("__digest").alias("__own"), "__maybe")
    kept = told.where("not __maybe").unionByName(told.where("__maybe").join(gone, same, "left_anti")).drop("__maybe")
    twice = materialize(sketches.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    if not twice.isEmpty():
        one = Window.partitionBy("doc_id", "__own").orderBy(F.col("text").asc_nulls_first())
        some = kept.join(twice, same, "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
        kept = kept.join(twice, same, "left_anti").unionByName(some)
    return kept.select(*docs.columns)
