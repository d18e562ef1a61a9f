import random

import xxhash
from pyspark.sql import functions as F

from corpusflow.llm import simhash as S


def brute(text, words=3):
    t = text or ""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(items):
    """Brute-force components of (id, fp) at two bits or fewer."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    best = {}
    for i, (doc, _) in enumerate(items):
        r = find(i)
        best[r] = doc if best.get(r) is None else best[r] if doc is None else min(best[r], doc)
    return sorted(((doc, best[find(i)]) for i, (doc, _) in enumerate(items)), key=str)


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        t = "".join(rng.choice("aB cé\t\n漢 d ") for _ in range(rng.randint(0, 80)))
        assert S.fingerprint(t) == brute(t)
        assert S.fingerprint(t, 5) == brute(t, 5)
    assert S.fingerprint(None) == S.fingerprint("  \n") == 0
    long = " ".join(str(i % 977) for i in range(150_000))
    assert S.fingerprint(long) == S.fingerprint(long.upper())


def test_links_are_exact_on_dense_fingerprints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in S.links(df).collect()}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
    items = list(enumerate(fps))
    want = classes(items)
    from corpusflow.operators.components import connected_components

    comp = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in connected_components(spark.createDataFrame([(signed(a), signed(b)) for a, b in edges], "a long, b long")).collect()}
    got = {}
    for i, x in items:
        got.setdefault(comp.get(x, x), []).append(i)
    assert sorted((i, min(g)) for g in got.values() for i in g) == sorted(want)


def test_components_with_chains_hubs_and_odd_rows(spark):
    from corpusflow.operators.components import connected_components

    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 101 + i) for i in range(50)]
    odd = [(None, 5), (7, 7), (3, None), (0, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain + hub + odd, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(51)} == {100} and len(got) == 92
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    extra = [(10_000, None), (10_001, ""), (10_002, docs[0][1]), (None, docs[0][1].upper()), (10_003, "one two"), (10_003, "one two")]
    rows = docs + extra
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == classes([(i, brute(t)) for i, t in rows])
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark, sf):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choices(words, k=rng.randint(60, 400)) for _ in range(60)]
    rows, group = [], {}
    for g, w in enumerate(base):
        for c in range(rng.randint(1, 5)):
            t = list(w)
            if c:
                t[rng.randrange(len(t))] = f"edit{c}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, node int")
    odd = spark.createDataFrame([(None, "alone and without a number", "x", 1), (None, "another one without a number", "x", 1), (9_000, None, "x", 1), (9_001, "", "x", 1), (9_002, "twice", "x", 1), (9_002, "twice", "x", 1)], df.schema)
    kept = S.keep_one(df.unionByName(odd))
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    alike = {}
    for i, t in rows:
        leader = next((j for j, u in rows[: i + 1] if group[j] == group[i] and S.alike(t, u, 5, 0.8)), i)
        alike[i] = leader
    want = {alike[i] for i, _ in rows if alike[i] == i}
    got = {i for i in ids if i is not None and i < 9_000}
    assert got <= {i for i, _ in rows} and len(got ^ want) <= 1 and len({group[i] for i in got}) == len(base)
    assert sorted(i for i in ids if i is not None and i >= 9_000) == [9_000, 9_002] and ids.count(None) == 2
    assert S.keep_one(df.limit(0)).count() == 0


def test_pairs_behind_a_hub_passage_are_found(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"f{rng.getrandbits(60)}" for _ in range(n)]
    hub = fresh(240)
    texts = [hub + fresh(60) for _ in range(100)] + [fresh(60) + hub for _ in range(2)]
    for at in range(50):  # pairs of similarity 0.8 or a little more, in the middle of the ids
        tail = fresh(60)
        texts[25 + at] = hub + tail
        texts.append(hub[:33] + hub[66:] + tail) if at % 2 else texts.append(hub + tail[:30] + fresh(8))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(S.shingle_set(t, 5).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fp = {i: S.fingerprint(t, 5) for i, t in rows}
    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if j < i and (common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) or bin(fp[i] ^ fp[j]).count("1") <= 2):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = sorted(i for i in sets if find(i) == i)
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == want and len(want) < len(rows)


def test_repeated_ids_with_different_texts_stay(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(f"v{rng.getrandbits(60)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (3, c), (3, c), (4, c + " end"), (None, a), (None, "alone")]
    got = sorted(map(tuple, S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "alone")], key=str)


def test_what_is_broadcast_does_not_grow(spark, monkeypatch):
    """A map of bits of fixed size stands for any number of keys, and loses none of them."""
    text = lambda n: F.sha2(n.cast("string"), 256).cast("binary")
    keys = spark.range(200_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), text(F.col("id")).alias("digest"))
    others = spark.range(10_000_000, 10_100_000).select("id", text(F.col("id")).alias("digest"))
    monkeypatch.setattr(S, "MAP_BITS", 1 << 22)
    found = S.key_map(keys, ["id", "digest"]).agg(F.count("*").alias("n"), F.max(F.length("__bits")).alias("size")).first()
    assert found.n * found.size <= S.MAP_BITS // 8
    assert S.marked(keys, keys, ["id", "digest"]).where("__maybe").count() == 200_000
    told = S.marked(others, keys, ["id", "digest"])
    assert told.columns == ["id", "digest", "__maybe"] and told.count() == 100_000 and told.where("__maybe").count() < 6_000
    assert S.marked(others, keys.limit(0), ["id", "digest"]).where("__maybe").count() == 0


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    rng = random.Random(13)
    shared = [[f"s{g}w{i}" for i in range(30)] for g in range(3)]  # passages of 30, 60 and 90 documents
    texts = [" ".join(shared[g] + [f"f{rng.getrandbits(60)}" for _ in range(60)]) for g in range(3) for _ in range(30 * (g + 1))]
    rows = spark.createDataFrame([(i, b"", t) for i, t in enumerate(texts)], "id long, digest binary, text string")
    assert len(S.hot_shingles(rows, 5)[0]) == 3 * 26
    docs = rows.select(F.col("id").alias("doc_id"), "text")
    kept = sorted(r.doc_id for r in S.keep_one(docs).collect())
    for most, want in ((60, [60] * 26 + [90] * 26), (26, [90] * 26), (25, [])):
        monkeypatch.setattr(S, "HOT_MOST", most)
        keys, n = S.hot_shingles(rows, 5)
        assert sorted(n.tolist()) == want and keys.tolist() == sorted(keys.tolist())
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == kept
