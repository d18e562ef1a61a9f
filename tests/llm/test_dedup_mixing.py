import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import dedup, mixing

ROWS = [(3, "a b"), (1, "a  b"), (1, "a  b"), (2, "c"), (None, "c"), (5, None), (4, ""), (7, " "), (None, "q"), (None, "q"), (8, "x" * 200_000), (9, "x" * 200_000)]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out, seen = [], set()
    for i, t in rows:
        n = norm(t)
        ids = [x for x in groups[n] if x is not None]
        keep = min(ids) if ids else None
        first = i == keep and n not in seen
        if first:
            seen.add(n)
        out.append((i, keep, len(groups[n]), first, hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.substring(dedup.sha256(c), 1, 1), lambda c: F.lit("same")])
def test_groups_match_brute_force_even_with_clashing_digests(spark, digest):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, content int")
    got = dedup.exact_groups(df, digest=digest, salts=3)
    want = Counter((a, b, c, d) for (a, b, c, d, _), n in brute(ROWS).items() for _ in range(n))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_digests_and_kept_rows(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string")
    assert Counter(map(tuple, dedup.exact_groups(df).collect())) == brute(ROWS)
    kept = dedup.distinct_documents(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "a  b"), (2, "c"), (4, ""), (7, " "), (None, "q"), (8, "x" * 200_000)])
    assert dedup.exact_groups(df.limit(0)).count() == 0


def water(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in capped]
        if not left or not total:
            return {s: float(most * sizes[s]) if s in capped else 0.0 for s in names}
        level = (total - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in left)
        over = {s for s in left if w[s] * level > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else w[s] * level for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5, None: 40, "é": 300}, {"a": 0, "b": 7}, {"x": 100}, {None: 3}, {"a": 0}])
def test_targets_match_water_filling(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("target", F.lit("clash")).withColumn("copies", F.lit(9))
    docs = docs.unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")))
    rows = mixing.mixed_sizes(docs).collect()
    again = mixing.mixed_sizes(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - total) < 0.25 * total
    drawn = mixing.mix(docs)
    assert drawn.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in drawn.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.mixed_sizes(docs.limit(0)).count()
