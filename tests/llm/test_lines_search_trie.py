import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import lexical, linededup, queries, trie
from corpusflow.runtime import materialize

SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("name", ["op11_linededup", "op12_lexical", "op13_trie"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    out = queries.QUERIES[name](spark, sf)
    got = Counter(map(tuple, out.select(sorted(out.columns)).collect()))
    want = con.execute(f"SELECT {', '.join(sorted(out.columns))} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == Counter(map(tuple, want)) and got


# Lines


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(*SMALL))


def brute_lines(rows, min_length=20, min_docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_length:
                holders[line_key(line)].add(i)
    keep = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if line_key(x) not in keep or keep[line_key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return Counter(out)


A, B, C = "a line that is long enough", "Ünïcode line of twenty c", "exactly twenty chars"
LINES = [
    (1, f"{A}\nshort\n  {A.upper()}\t"), (2, f"{A}\n{B}"), (3, f"x\n{A}\n\n{A}"), (4, f"{B}\n{C}\r\n{C}"), (5, f"{C}\n{B}\n"), (6, C), (6, f"{C}\nother"), (6, C),
    (7, None), (8, ""), (9, "\n"), (None, f"{A}\n{B}"), (None, A), (10, "\n".join([A] * 30_000 + ["end"])), (-5, f"\x0b{C}\x0c"), (11, C[:-1]), (12, C[:-1]), (13, C[:-1]),
    (14, "ß" * 20), (15, "ß" * 20), (16, "ß" * 20 + " "),
]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_shared_lines_match_brute_force(spark, batches, fanout):
    df = spark.createDataFrame([(i, t, 9, "c") for i, t in LINES], "doc_id long, text string, n_lines int, pos string").repartition(3)
    got = linededup.drop_shared_lines(df, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "pos", "text", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(LINES)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_shared_lines_of_odd_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in LINES], "doc_id long, text string")
    assert linededup.drop_shared_lines(df.limit(0)).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert linededup.drop_shared_lines(nulls).agg(F.sum("n_dropped")).first()[0] == 0
    rng = random.Random(3)
    many = [(i, "\n".join(f"line {int(rng.paretovariate(0.7))} of the corpus we made" for _ in range(rng.randrange(12)))) for i in range(300)]
    got = linededup.drop_shared_lines(spark.createDataFrame(many, "doc_id long, text string"), batches=5, fanout=2)
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == brute_lines(many)


# Search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    bag = lambda t: Counter(TERM.findall((t or "").translate(str.maketrans(*SMALL))))
    bags = [(i, bag(t)) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // max(length, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in bag(text).items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return Counter(out)


def made_documents(n, rng):
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[i * 3][1]) for i in range(n // 6)]  # ties
    return docs + [(None, docs[0][1]), (5, docs[5][1]), (9_000, None), (9_001, ""), (9_002, " .,;"), (9_003, "Ä É " * 9 + "W1-w2_W3"), (9_004, "w7 " * 40_000)]


@pytest.mark.parametrize("block,leaf,group", [(1_024, 32, 512 * 1024), (16, 2, 60), (7, 1, 1)])
def test_search_matches_brute_force(spark, block, leaf, group):
    rng = random.Random(block)
    docs = made_documents(150, rng)
    items = [(i, docs[rng.randrange(150)][1][:80]) for i in range(6)] + [(6, None), (7, "unseen words"), (8, "W1 w1 w2, É é"), (None, "w3"), (3, "w9 w9 w8"), (3, "w9 w9 w8")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, n int, score int").repartition(3)
    got = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), k=4, group_bytes=group, block_docs=block, leaf=leaf)
    assert Counter(map(tuple, got.collect())) == brute_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, items.limit(0)).count() == 0 == lexical.search(docs.limit(0), items).count()
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_the_tree_prunes_and_its_bounds_hold():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(c * 50, c * 50 + 60, 30)) for c in range(8) for _ in range(64)]  # eight themes
    start, term = np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.concatenate(rows)
    value = rng.integers(1, 1_000_000, len(term))
    scale = np.sqrt(rng.integers(1, 9_000, 500)).astype(float)
    tree = lexical.BallTree(start, term, value, scale, leaf=8)
    assert sorted(tree.rows) == list(range(512))
    dense = np.zeros((512, 500), np.int64)
    dense[np.repeat(np.arange(512), np.diff(start)), term] = value
    scored = 0
    for theme in range(8):
        own = np.arange(theme * 50 + 5, theme * 50 + 30)
        weight = rng.integers(1, 9_000, len(own))
        heap = []
        scored += tree.search(own, weight, scale, heap, 5, list(range(512)))
        want = sorted(((int(s), -i) for i, s in enumerate(dense[:, own] @ weight)), reverse=True)[:5]
        assert sorted(heap, reverse=True) == want
    assert scored < 0.5 * 8 * tree.leaves


# Trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, convs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (min(c), len(p), min(members[p[:-1]]) if p else None, len(c), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, c in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_conversations():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, "x" * 50])) for c in range(-12, 60) for t in range(rng.randrange(9)) if c % 7]
    rows += [(400 + c, t, "user", f"turn {t}") for c in range(40) for t in range(4)]  # copies
    rows += [(700, t, "user", f"long {t % 3}") for t in range(900)]  # one conversation of many turns
    rows += [(800, None, "user", "null first"), (800, 1, "user", "tie b"), (800, 1, "user", "tie a"), (800, 1, "user", "tie a"), (None, 1, "user", "nobody"), (801, 0, "a", "bc"), (802, 0, "ab", "c"), (901, 0, "u", "w" * 300_000)]
    return rows


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "LAST", 50)
    monkeypatch.setattr(trie.list_rank, "__defaults__", (4, 50, 0))
    monkeypatch.setattr(trie._ends, "__defaults__", (8,))
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    got = trie.prefix_trie(trie.rebuilt(df))
    assert got.columns == COLUMNS
    want = brute_trie(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert max(want.values()) == 1 and trie.prefix_trie(trie.rebuilt(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_list_ranks(spark, n):
    order = list(range(n))
    random.Random(n).shuffle(order)
    arcs = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:] + [None], strict=True)], "arc long, next long")
    got = {r.arc: r.left for r in trie.list_rank(arcs, ruling=3, last=10).collect()}
    assert got == {a: n - i for i, a in enumerate(order)}


def test_sums_of_a_key_in_many_slices(spark):
    rows = [(k, i, v) for k, n in (("a", 3), ("b", 400), ("c", 1), ("d", 60)) for i, v in enumerate([2] * n)] + [("b", 1_000, 5)] * 200
    df = materialize(spark.createDataFrame(rows, "key string, i long, v long"))
    got = trie.keyed_prefix_sums(df, "key", [F.col("i")], {"upto": F.col("v")})
    by_key = defaultdict(list)
    for r in got.collect():
        by_key[r.key].append((r.i, r.upto, r.v))
    for found in by_key.values():
        total = 0
        for _, upto, v in sorted(found):
            total += v
            assert upto == total
