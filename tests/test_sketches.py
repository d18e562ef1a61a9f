"""Day sketches against exact counts: batches, ranges, repeats and repairs."""

from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from corpusflow.operators import sketches as SK

KEPT = SK.Daily("d", {"n": "true", "odd": "v % 2 = 1"}, {"values": "v"})
FIRST = date(2024, 1, 1)


def rows(spark, *parts):
    """Parts (day, low, high): the values of a range on a day, each twice."""
    out = spark.createDataFrame([], "d date, v long")
    for day, low, high in parts:
        part = spark.range(low, high).select(F.lit(FIRST + timedelta(day)).alias("d"), F.col("id").alias("v"))
        out = out.unionByName(part).unionByName(part)
    return out


def days(spark, folder, **how):
    return {r.day: (r.n, r.odd, r["values"]) for r in SK.by_day(spark, KEPT, folder, **how).collect()}


def test_days_and_ranges_within_the_stated_error(spark, tmp_path):
    folder = str(tmp_path)
    SK.add_batch(rows(spark, (0, 0, 40_000), (1, 20_000, 60_000), (2, 0, 100)), KEPT, folder, 0)
    got = days(spark, folder)
    assert {d: v[:2] for d, v in got.items()} == {FIRST: (80_000, 40_000), FIRST + timedelta(1): (80_000, 40_000), FIRST + timedelta(2): (200, 100)}
    assert abs(got[FIRST][2] / 40_000 - 1) < 0.02 and got[FIRST + timedelta(2)][2] == 100
    whole = SK.over_range(spark, KEPT, folder).first()
    assert whole.n == 160_200 and abs(whole["values"] / 60_000 - 1) < 0.02  # values of several days count once
    part = SK.over_range(spark, KEPT, folder, FIRST + timedelta(1), FIRST + timedelta(2)).first()
    assert part.n == 80_200 and abs(part["values"] / 40_100 - 1) < 0.02
    assert set(days(spark, folder, since=FIRST + timedelta(2))) == {FIRST + timedelta(2)}


def test_a_late_batch_adds_to_its_own_day_and_repeats_replace(spark, tmp_path):
    folder = str(tmp_path)
    SK.add_batch(rows(spark, (0, 0, 10), (1, 0, 10)), KEPT, folder, 0)
    before = sorted(p.stat().st_mtime_ns for p in Path(folder).glob("sketches/batch=0/*/*.parquet"))
    for _ in range(2):
        SK.add_batch(rows(spark, (0, 5, 15)), KEPT, folder, 1)
    assert [p.name for p in Path(folder).glob("sketches/batch=1/day=*")] == ["day=2024-01-01"]
    assert sorted(p.stat().st_mtime_ns for p in Path(folder).glob("sketches/batch=0/*/*.parquet")) == before
    assert days(spark, folder) == {FIRST: (40, 20, 15), FIRST + timedelta(1): (20, 10, 10)}


def test_a_repair_holds_until_a_later_batch(spark, tmp_path):
    folder, first = str(tmp_path), rows(spark, (0, 0, 50_000))
    SK.add_batch(first, KEPT, folder, 0)
    SK.repair(first, KEPT, folder, 0)
    assert days(spark, folder)[FIRST][2] == 50_000
    SK.add_batch(rows(spark, (0, 50_000, 60_000)), KEPT, folder, 1)
    assert 58_000 < days(spark, folder)[FIRST][2] < 62_000
    SK.repair(rows(spark, (0, 0, 60_000)), KEPT, folder, 1)
    assert days(spark, folder)[FIRST] == (120_000, 60_000, 60_000)


def test_null_days_null_values_and_no_rows(spark, tmp_path):
    folder = str(tmp_path)
    SK.add_batch(rows(spark), KEPT, folder, 0)
    assert days(spark, folder) == {} and tuple(SK.over_range(spark, KEPT, folder).first()) == (0, 0, 0)
    odd = spark.createDataFrame([(None, 1), (None, None), (FIRST, None)], "d date, v long")
    SK.add_batch(odd, KEPT, folder, 1)
    assert days(spark, folder) == {None: (2, 1, 1), FIRST: (1, 0, 0)}
