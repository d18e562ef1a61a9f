"""Keys of earlier batches against a plain set."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import seen as SN

KIND = "id long, source string, url string"


def batches_of(n, rows=60, seed=3):
    """Rows of a few hundred keys, one of them in a third of the rows; nulls too."""
    own = random.Random(seed)
    out, at = [], 0
    for _ in range(n):
        batch = []
        for _ in range(rows):
            url = "u-hot" if own.random() < 0.33 else None if own.random() < 0.05 else f"u{own.randrange(400)}"
            batch.append((at, own.choice(["a", "b", None]), url))
            at += 1
        own.shuffle(batch)
        out.append(batch)
    out.insert(2, [])
    return out


def plain(batches, key):
    known, out = set(), []
    for batch in batches:
        new = {}
        for row in sorted(batch):
            if key(row) not in known:
                new.setdefault(key(row), row)
        known |= set(new)
        out.append(sorted(new.values()))
    return out


@pytest.mark.parametrize(("keys", "key", "batches"), [(["url"], lambda r: r[2], 6), (["source", "url"], lambda r: r[1:], 3)])
def test_new_rows_are_those_of_a_set(spark, tmp_path, keys, key, batches):
    batches = batches_of(batches)
    for n, (batch, want) in enumerate(zip(batches, plain(batches, key), strict=True)):
        rows = spark.createDataFrame(batch, KIND)
        got = SN.admit_new(rows, n, str(tmp_path), keys, ["id"], expected=500, fan=2)
        assert sorted(map(tuple, got.collect())) == want, n
        SN.drop_merged(spark, str(tmp_path), n, fan=2)  # no later batch misses them
        stays = {(level, run) for k in (n, n + 1) for level, run in SN.runs_before(k, 2)}
        for kind in ("keys", "filters"):
            assert {tuple(int(x.split("=")[1]) for x in p.parts[-2:]) for p in Path(tmp_path, kind).glob("level=*/run=*")} == stays
        if n == 3:  # a batch that is run again gives the same and changes nothing
            again = SN.admit_new(rows, n, str(tmp_path), keys, ["id"], expected=500, fan=2)
            assert sorted(map(tuple, again.collect())) == want


def test_rows_stay_right_when_the_filters_are_full(spark, tmp_path):
    """Ten thousand times the keys that the filters were laid out for."""
    for n, (low, high) in enumerate([(0, 300_000), (150_000, 320_000)]):
        rows = spark.range(low, high).select("id", F.col("id").cast("string").alias("url"))
        got = SN.admit_new(rows, n, str(tmp_path), ["url"], ["id"], expected=30)
        assert got.count() == (300_000, 20_000)[n]


def test_runs_cover_each_batch_before_once():
    for fan in (2, 3, 8):
        for number in range(200):
            held = sorted(b for level, run in SN.runs_before(number, fan) for b in range(run * fan**level, (run + 1) * fan**level))
            assert held == list(range(number))


def test_only_buckets_that_the_filters_let_through_are_read(spark, tmp_path):
    old = spark.range(2_000).select("id", F.concat(F.lit("u"), "id").alias("url"))
    SN.admit_new(old, 0, str(tmp_path), ["url"], ["id"], expected=100_000)
    new = spark.createDataFrame([(9_000, "u7"), (9_001, "fresh")], "id long, url string")
    met = SN.passing(new, str(tmp_path), 1, ["url"], 100_000)
    maybe = {r.url: (r["__maybe"], r["__bucket"]) for r in met.collect()}
    assert maybe["u7"][0] and not maybe["fresh"][0]
    for folder in Path(tmp_path, "keys/level=0/run=0").glob("__bucket=*"):
        if folder.name != f"__bucket={maybe['u7'][1]}":  # the other folders need not be readable
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"broken")
            for crc in folder.glob(".*.crc"):
                crc.unlink()
    assert [r.url for r in SN.unseen(new, str(tmp_path), 1, ["url"], ["id"], 100_000).collect()] == ["fresh"]


def test_few_new_keys_pass_the_filters(spark, tmp_path):
    """At the number of keys that the filters are laid out for."""
    old = spark.range(60_000).select("id", F.concat(F.lit("old"), "id").alias("url"))
    SN.admit_new(old, 0, str(tmp_path), ["url"], ["id"], expected=60_000)
    new = spark.range(20_000).select("id", F.concat(F.lit("new"), "id").alias("url"))
    met = SN.passing(new.unionByName(old), str(tmp_path), 1, ["url"], 60_000)
    passed = met.groupBy(F.col("url").startswith("new").alias("new")).agg(F.avg(F.col("__maybe").cast("int")).alias("share")).collect()
    share = {r["new"]: r.share for r in passed}
    assert share[False] == 1 and share[True] < 0.03
