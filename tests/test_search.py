"""The trigram index against LIKE over all rows."""

import random
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import feed
from corpusflow.operators import search as SE
from corpusflow.plans import fixtures as X

PATTERNS = ["%there%", "%THE%", "%th_re%ing%", "%of the%", "%zzzqqq%", "%a%", "%_%", "the%", "%.", "%100\\%%", "%a\\_b%", "%ÉTÉ%", "%giảm GIÁ%", ""]


@pytest.fixture(scope="module")
def texts(spark, sf):
    own = [(10_000 + i, t) for i, t in enumerate(["Only 100% wool", "a_b", "axb", "Un été chaud", "GIẢM GIÁ sốc", "", None, "ab", "there THERE " * 500, "x" * 5_000 + " there"])]
    given = X.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return given.unionByName(spark.createDataFrame(own, "id long, text string")).cache()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    SE.add_to_index(texts, path, ["text"])
    return path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_rows_are_those_of_like(texts, index, pattern):
    want = sorted(r.id for r in texts.where(F.col("text").ilike(pattern)).select("id").collect())
    assert sorted(r.id for r in SE.like(texts, index, pattern, ["text"]).select("id").collect()) == want


def test_only_the_folders_of_the_pattern_are_read(texts, index, tmp_path):
    wanted = SE._wanted(texts.sparkSession, "%There%")
    assert {g for g, _ in wanted} == {"the", "her", "ere"}
    part = str(tmp_path / "part")
    for bucket in {b for _, b in wanted}:
        shutil.copytree(f"{index}/batch=0/bucket={bucket}", f"{part}/batch=0/bucket={bucket}")
    got = [r.id for r in SE.like(texts, part, "%There%", ["text"]).select("id").collect()]
    assert sorted(got) == sorted(r.id for r in SE.like(texts, index, "%There%", ["text"]).select("id").collect()) and got
    plan = SE.candidates(texts, index, "%There%")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)
    assert len(list(Path(index).glob("batch=0/bucket=*"))) > 100


def test_most_rows_are_ruled_out(texts, index):
    hits = SE.like(texts, index, "%wool%", ["text"]).count()
    assert hits >= 1 and SE.candidates(texts, index, "%wool%").count() <= hits + 5


def test_literals():
    assert SE.literals("%ab_c%%d\\%e\\\\%") == ["ab", "c", "d%e\\"] and SE.literals("%_%") == []


def test_batches_are_added_replaced_and_compared_in_full(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "id string, a string, b string"
    first = spark.createDataFrame([("x", "old words", None), ("y", None, "new words"), (None, "words", "words")], schema)
    SE.add_to_index(first, path, ["a", "b"])
    SE.add_to_index(first, path, ["a", "b"])  # run again
    later = spark.createDataFrame([("x", "other", None), ("z", "the words", "words")], schema)
    SE.add_to_index(later, path, ["a", "b"], batch=1)
    now = first.where("id <> 'x'").unionByName(later)
    assert sorted(r.id for r in SE.like(now, path, "%WORD%", ["a", "b"]).collect()) == ["y", "z"]
    assert [r.id for r in SE.like(now, path, "%other%", ["a", "b"]).collect()] == ["x"]


def test_an_index_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    SE.add_to_index(none, str(tmp_path), ["text"])
    assert SE.like(none, str(tmp_path), "%there%", ["text"]).count() == 0


def test_feed_search_is_the_same_with_an_index(spark, sf, tmp_path):
    articles, sources = X.articles(spark, sf), X.sources(spark, sf)
    SE.add_to_index(articles, str(tmp_path), ["title", "summary_short", "tldr"])
    for text in ("there", "on", "w_th"):
        assert feed.search(articles, sources, text, X.as_of(), index=str(tmp_path)).collect() == feed.search(articles, sources, text, X.as_of()).collect()


def test_grams_are_made_once_and_kept_in_lists(spark, tmp_path):
    """Wide alphabets, NUL and characters beyond two bytes too."""
    rng = random.Random(5)
    own = ["", None, "ab", "a\0b\0", "x\0\0\0", "🙂ß€a🙂", "".join(chr(0x4E00 + i) for i in range(6_000))] + ["".join(rng.choices("abc é€🙂", k=rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, t and t[::-1]) for i, t in enumerate(own)], "id long, a string, b string").coalesce(1)
    want = {(x.lower()[i : i + 3], n) for n, t in enumerate(own) if t is not None for x in (t, t[::-1]) for i in range(len(x) - 2)}
    got = [(r.gram, i) for r in SE.postings(rows, ["a", "b"]).collect() for i in r.ids]
    assert len(got) == len(set(got)) and set(got) == want
    SE.add_to_index(rows, str(tmp_path), ["a", "b"])
    assert spark.read.parquet(str(tmp_path)).count() < len(want) / 1.5  # a row for each list, not for each text


@pytest.mark.parametrize("bits", [1 << 6, 1 << 26])
def test_found_ids_reach_the_texts_in_a_map_of_fixed_size(texts, index, bits, monkeypatch):
    """No text is shuffled or sorted for the join, however many ids are found, and ids that share bits are compared in full."""
    monkeypatch.setattr(SE, "MAP_BITS", bits)
    found = SE.like(texts, index, "%Of the%", ["text"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and sorted(r.id for r in found.collect()) == sorted(r.id for r in texts.where(F.col("text").ilike("%Of the%")).collect())
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert SE.narrowed(texts, index, "%Of the%").count() >= found.count() > 0


def test_ids_are_stored_by_their_differences(index):
    import pyarrow.parquet as pq

    file = pq.ParquetFile(next(Path(index).glob("batch=0/bucket=*/*.parquet")))
    assert "DELTA_BINARY_PACKED" in file.metadata.row_group(0).column(1).encodings
