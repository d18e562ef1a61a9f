"""Clusters and streams against loops that follow the rules one row at a time."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.text import top_keywords
from corpusflow.operators import cluster as K
from corpusflow.operators import stats as G
from corpusflow.plans import q_streams as Q
from corpusflow.plans.q_text import near, summarised
from corpusflow.streaming import jobs as ST


def one_by_one(rows, scored, most=200, hours=6):
    """``rows`` of (id, created, finished, forum) in seconds; ``scored`` gives (score, title_score, novelty) of a pair, the later one first."""
    leads, parent = [], {}
    for i, created, finished, forum in sorted(rows, key=lambda r: (r[2], r[0])):
        met = sorted((c, j, f) for j, c, f in leads if finished - c <= hours * 3600)[-most:]
        own = [(scored[i, j][0], c, j) for c, j, f in met if not f and (i, j) in scored and not forum]
        best = max(own)[2] if own else None
        if best is not None and (scored[i, best][1] >= 0.85 or scored[i, best][2] < 0.3):
            parent[i] = best
        else:
            leads.append((i, created, forum))
    return parent


def scores_of(rows):
    f = K.features(rows.select("id", "created_at", "image_url", "translated_title", "summary_short"), "translated_title", "summary_short").cache()
    a, b = f.alias("a"), f.alias("b")
    pairs = a.join(b, F.col("a.id") != F.col("b.id"))  # a small table
    keep = [F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.col("a.kw").alias("x"), F.col("b.kw").alias("y")]
    scored = K.with_scores(pairs, keep).where("score >= 0.6").select("i", "j", "score", "title_score", K.novelty(F.col("x"), F.col("y")).alias("n")).collect()
    return {(r.i, r.j): (r.score, r.title_score, r.n) for r in scored}


def parents_of(rows, forum=None, **how):
    out = K.second_pass(rows, F.lit(False) if forum is None else forum, F.lit("2100-01-01").cast("timestamp"), "finished_at", **how)
    return {r.id: r.parent_article_id for r in out.collect() if r.parent_article_id is not None}


def test_second_pass_follows_the_sequential_rule(spark, sf):
    rows = summarised(spark, sf).where("id < 160")
    scored = scores_of(rows)
    forum = F.pmod(F.col("id"), F.lit(9)) == 4
    times = [(r.id, r.c, r.f, r.id % 9 == 4) for r in rows.select("id", F.unix_timestamp("created_at").alias("c"), F.unix_timestamp("finished_at").alias("f")).collect()]
    plain = [(*t[:3], False) for t in times]
    results = set()
    for most, size in ((200, 1_000), (200, 13), (5, 20)):
        want = one_by_one(plain, scored, most)
        assert parents_of(rows, leaders=most, slice_rows=size) == want and want
        results.add(tuple(want.items()))
    assert len(results) == 2  # the cap tells
    assert parents_of(rows, forum, leaders=30, slice_rows=25) == one_by_one(times, scored, 30)
    assert parents_of(rows.limit(0)) == {}


def test_second_pass_with_more_leaders_than_the_cap(spark):
    """Over 200 leaders in six hours: stories come back before and after they are pushed out."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(900)]
    stories = [" ".join(rng.choices(words, k=9)) for _ in range(420)]
    rows = []
    for i in range(700):
        text = stories[rng.randrange(420)].split()
        if rng.random() < 0.5:
            text[rng.randrange(9)] = rng.choice(words)
        rows.append((i, 1_700_000_000 + i * 25, 1_700_000_000 + i * 25 + rng.randrange(900), " ".join(text), None if i % 7 else f"img{i % 21}", "done", None, None))
    df = spark.createDataFrame(rows, "id long, c long, f long, translated_title string, image_url string, summary_status string, parent_article_id long, last_summary_error string")
    df = df.select("*", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("f").alias("finished_at"), F.lit("").alias("summary_short"))
    scored = scores_of(df)
    times = [(r[0], r[1], r[2], False) for r in rows]
    want = one_by_one(times, scored)
    assert want != one_by_one(times, scored, 10_000) and len(rows) - len(want) > 400
    for size in (10_000, 90):
        assert parents_of(df, slice_rows=size) == want


def test_a_follower_is_no_candidate_any_more(spark):
    """B attaches to A; C is like B only, so C stays a leader though B lies near."""
    words = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzba", "dcfe", "hgji", "lknm", "porq"]
    titles = [" ".join(words[:8]), " ".join(words[:7] + words[8:9]), " ".join(words[2:7] + words[8:])]
    rows = [(i, t, None, "", "done", None, None) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, translated_title string, image_url string, summary_short string, summary_status string, parent_article_id long, last_summary_error string")
    df = df.withColumn("created_at", F.timestamp_seconds(F.col("id") * 60)).withColumn("finished_at", F.col("created_at"))
    scored = scores_of(df)
    assert (2, 1) in scored and (2, 0) not in scored
    assert parents_of(df) == one_by_one([(i, i * 60, i * 60, False) for i in range(3)], scored)


def test_sketches_drop_no_similar_pair_and_most_others(spark, sf):
    rows = near(spark, sf)
    base = K.features(rows.select("id", "created_at", "image_url", "title", "raw_excerpt")).cache()
    all_pairs = K.with_scores(K.window_pairs(base), [F.col("a.id").alias("id"), F.col("b.id").alias("other_id")]).cache()
    want = {(r.id, r.other_id) for r in all_pairs.where(F.col("score") >= K.SIMILARITY).collect()}
    found = {(r.id, r.other_id) for r in K.candidate_pairs(base).collect()}
    assert want and want <= found and len(found) * 10 < all_pairs.count()


@pytest.mark.parametrize("text", ["", "a bb ccc ccc dd ddd ddd ddd ccc eee", "zzz yyy xxx zzz", "x" * 50, "aaa " * 3000 + "bbb " * 2000])
def test_keywords(spark, text):
    words = [w for w in text.split(" ") if len(w) >= 3]
    want = sorted(set(words), key=lambda w: (-words.count(w), words.index(w)))[:30]
    assert spark.createDataFrame([(text,)], "t string").select(top_keywords(F.col("t")).alias("k")).first().k == want


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_arrivals_in_batches_equal_the_whole(spark, sf, parts):
    rows = near(spark, sf).where("id < 120").select("id", "created_at", "image_url", "title", "raw_excerpt")
    want = sorted((r.id, r.best_id, r.accepted) for r in K.parent_edges(rows).collect())
    out = Q.batches(Q.parts_in_order(rows, "id", parts), ST.cluster_arrivals)
    assert out.count() == rows.count() and out.select("batch").distinct().count() <= parts  # nothing to correct
    assert sorted((r.id, r.best_id, r.accepted) for r in ST.latest(out).where("best_id is not null").collect()) == want and want


def test_parts_are_written_by_many_tasks_and_arrive_whole(spark):
    """Every part comes from all tasks that read rows of it; rows without a place are in the first part, once."""
    rows = spark.range(0, 400, 1, 8).select(F.when(F.col("id") != 7, F.when(F.col("id") < 200, F.col("id")).otherwise(F.col("id") + 200)).alias("at"), F.col("id").alias("v"))
    out = Q.batches(Q.parts_in_order(rows, "at", 3), lambda b, n, f: b.withColumn("files", F.input_file_name()))
    got = {r["batch"]: (r.n, r.files, r.low, r.high) for r in out.groupBy("batch").agg(F.count("v").alias("n"), F.count_distinct("files").alias("files"), F.min("at").alias("low"), F.max("at").alias("high")).collect()}
    assert got == {0: (200, 4, 0, 199), 2: (200, 4, 400, 599)}


def test_late_arrivals_correct_edges(spark, sf, tmp_path):
    """Batches mixed up at random give the edges of the whole table, taken-back ones too."""
    rows = near(spark, sf).where("id < 120").select("id", "created_at", "image_url", "title", "raw_excerpt")
    want = sorted((r.id, r.best_id, r.accepted) for r in K.parent_edges(rows).collect())
    rng = random.Random(9)
    part = {i: rng.randrange(3) for i in range(120)}
    given = {}
    for n in range(3):
        ids = [i for i in part if part[i] == n]
        got = ST.cluster_arrivals(rows.where(F.col("id").isin(ids)), n, str(tmp_path)).collect()
        given |= {r.id: (r.id, r.best_id, r.accepted) for r in got}
    assert sorted(e for e in given.values() if e[1] is not None) == want and want
    assert ST.cluster_arrivals(rows.limit(0), 3, str(tmp_path)).count() == 0


def test_late_calls_push_others_back(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), None if i % 40 == 39 else f"2024-01-0{1 + rng.randrange(3)} 00:{rng.randrange(60):02d}:00") for i in range(160)]
    calls = spark.createDataFrame(rows, "id long, provider string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {r.id: (r.k, r.allowed) for r in G.quota_admissions(calls, 4).collect()}
    got = {}
    for n in range(4):  # batches in no order of time
        got |= {r.id: (r.k, r.allowed) for r in ST.admissions(calls.where(F.pmod("id", F.lit(4)) == n), n, str(tmp_path), 4).collect()}
        got |= {r.id: (r.k, r.allowed) for r in ST.admissions(calls.where(F.pmod("id", F.lit(4)) == n), n, str(tmp_path), 4).collect()}  # a batch that runs twice
    assert got == want


def test_late_log_rows_within_the_watermark(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), rng.choice(["failed", "failed", "success"]), i * 60) for i in range(150)]
    mixed = sorted(rows, key=lambda r: r[3] + rng.randrange(1700))  # up to half an hour late
    last, sizes = None, []
    for n in range(5):
        part = spark.createDataFrame(mixed[n * 30 : n * 30 + 30], "id long, source_id string, status string, s long").withColumn("started_at", F.timestamp_seconds("s"))
        for _ in range(2):  # each batch runs twice
            last = ST.source_state(part, n, str(tmp_path), late_minutes=30).collect()
        sizes.append(spark.read.parquet(f"{tmp_path}/recent/batch={n}").count())
    want = {}
    for _, key, status, _ in rows:
        want[key] = want.get(key, 0) + 1 if status == "failed" else 0
    assert {r.source_id: r.failures for r in last} == want
    assert max(sizes) <= 31  # a row a minute: the state holds no more than the watermark


def test_admissions_count_over_batches_and_null_keys(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), f"2024-01-0{1 + i // 60} 00:{i % 60:02d}:00") for i in range(170)]
    calls = spark.createDataFrame(rows, "id long, provider string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    want, seen = {}, {}
    for i, key, ts in rows:
        seen[key, ts[:10]] = seen.get((key, ts[:10]), 0) + 1
        want[i] = (seen[key, ts[:10]], seen[key, ts[:10]] < 4)
    assert {r.id: (r.k, r.allowed) for r in G.quota_admissions(calls, 4).collect()} == want
    got = {}
    for n, (lo, hi) in enumerate([(0, 50), (50, 51), (51, 170)]):
        got |= {r.id: (r.k, r.allowed) for r in ST.admissions(calls.where(F.col("id").between(lo, hi - 1)), n, str(tmp_path), 4).collect()}
    assert got == want


def test_source_state_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.choice(["failed", "failed", "success"]), i // 2) for i in range(90)] + [(90 + i, "d", "failed", 50) for i in range(3)]
    rows.sort(key=lambda r: (r[3], r[0]))
    logs = spark.createDataFrame(rows, "id long, source_id string, status string, s long").withColumn("started_at", F.timestamp_seconds("s"))
    last = None
    for n, (lo, hi) in enumerate([(0, 10), (10, 11), (11, 60)]):
        last = ST.source_state(logs.where(f"s >= {lo} and s < {hi}"), n, str(tmp_path)).collect()
    want = {}
    for _, key, status, _ in rows:
        want[key] = want.get(key, 0) + 1 if status == "failed" else 0
    assert {r.source_id: r.failures for r in last} == want
    assert all(r.next_minutes == (min(60 * 2 ** (r.failures - 1), 1440) if r.failures else 60) for r in last)


@pytest.mark.parametrize("slice_seconds", [120, 3600])
def test_fixed_windows_follow_each_other(spark, slice_seconds):
    rng = random.Random(4)
    t, rows = 86_000, []
    for i in range(900):  # over midnight, with gaps and bursts
        t += rng.choice([0, 0, 1, 2, 7, 30, 61, 200])
        rows.append((i, rng.choice(["a", "b", None]), t))
    rows += [(1000 + i, "hot", 90_000 + i // 9) for i in range(800)] + [(5000, "a", None)]
    df = spark.createDataFrame(rows, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, state = {}, {}
    for i, key, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        start, n = state.get(key, (None, 0))
        start, n = (s, 1) if start is None or s - start >= 60 else (start, n + 1)
        state[key] = (start, n)
        want[i] = n <= 10
    want[5000] = False
    got = {r.id: r.allowed for r in ST.fixed_windows(df, 10, 60, slice_seconds).collect()}
    assert got == want and ST.fixed_windows(df.limit(0), 10).count() == 0


def test_candidates_over_blocks_are_those_of_the_window(spark, sf, monkeypatch):
    """Pairs over the edges of blocks, rows that do not look back and rows without a time; only one row of each pair is moved."""
    rows = near(spark, sf).where("id < 150").select("id", F.when(F.col("id") != 9, F.col("created_at")).alias("created_at"), "image_url", "title", "raw_excerpt", (F.col("id") % 3 == 0).alias("is_forum"))
    base = K.features(rows).cache()
    scored = K.with_scores(K.window_pairs(base), [F.col("a.id").alias("id"), F.col("b.id").alias("other_id"), F.col("a.is_forum").alias("is_forum")])
    want = {(r.id, r.other_id) for r in scored.where((F.col("score") >= K.SIMILARITY) & ~F.col("is_forum")).collect()}
    whole = None
    for size in (4_000, 32):
        monkeypatch.setattr(K, "BLOCK_ROWS", max(size, K.WINDOW_ROWS))
        out = [(r.id, r.other_id) for r in K.candidate_pairs(base, ~F.col("is_forum")).collect()]
        assert len(out) == len(set(out)) and want and want <= set(out) and not any(i % 3 == 0 or 9 in (i, o) for i, o in out)
        whole = whole or set(out)
        assert set(out) == whole


def test_leaders_are_filtered_as_pair_by_pair():
    """The sketches of all leaders are compared at once, with the outcome of one comparison a leader."""
    from collections import namedtuple

    import numpy as np

    from corpusflow.operators import cluster as K

    row, rng = namedtuple("row", "id created image_url forum tw tb ew eb kw"), np.random.default_rng(3)
    near = [np.arange(100, 100 + n) * 7919 for n in (6, 20, 30, 90)]

    def article(i):
        sets = [np.where(rng.random(len(s)) < rng.choice([0, 0.2, 0.4]), rng.integers(-(2**62), 2**62, len(s)), s) for s in near]
        return row(i, float(rng.integers(0, 1000)), [None, "", "a", "b"][i % 4], False, *sets, sets[0])

    most, rows = 30, [article(i) for i in range(80)]
    leads, plain = K._Leaders(iter(()), most), []
    for r in rows:
        own = K._Article(r)
        want = [o for o in reversed(plain) if o.place[0] >= 300 and own.scores(o)]
        assert [o.place for o in leads.like(own, 300)] == [o.place for o in want]
        leads.add(own)
        plain = sorted([*plain, own])[-most:]
        assert [o.place for o in leads.all] == [o.place for o in plain]
