import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from corpusflow.llm import bpe


def test_stages_and_whole_run(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, out, sf)
        assert sorted(new.columns) == sorted(columns), name
        before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (out, new))
        assert all(before[i] == t for i, t in after.items()), name
        if name == "exact_dedup":
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in after.values()]
            assert len(set(norm)) == len(norm) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in before.values()})
        out = new.cache()
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in whole) == Counter(r.doc_id for r in out.collect())
    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in whole[:20]:
        assert codec.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf):
    long = " ".join(f"w{i}" for i in range(60_000))
    words = " ".join(f"v{i}" for i in range(80))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (2, words + "  ", "en", "a"), (3, words + " end", "en", None), (None, None, None, None), (None, "alone " * 3, "en", "b"), (4, "", "en", "b"), (5, long, "en", "b"), (1, "other text of one", "en", "a")]
    names = "doc_id long, text string, lang string, source string, score string, copies string, row int, node long, digest string, n_chars int"
    docs = spark.createDataFrame([(*r, "s", "c", 7, 8, "d", 1) for r in rows], names)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted(((r.doc_id, (r.text or "")[:12].strip()) for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all(tuple(r[c] for c in ("score", "copies", "row", "node", "digest")) == ("s", "c", 7, 8, "d") for r in out.collect()), name
    clean = stages["toxicity"](spark, docs, sf)
    assert kept(clean) == kept(docs)
    once = stages["exact_dedup"](spark, clean, sf)
    assert kept(once) == sorted([(1, words[:12].strip()), (2, words[:12].strip()), (3, words[:12].strip()), (4, ""), (None, "alone alone"), (5, long[:12].strip()), (1, "other text o")], key=str)
    one = stages["simhash_near_dedup"](spark, once, sf)
    assert kept(one) == sorted([(1, words[:12].strip()), (4, ""), (None, "alone alone"), (5, long[:12].strip()), (1, "other text o")], key=str)
    out = stages["bpe"](spark, stages["mixing"](spark, one, sf), sf).collect()
    assert out and all(r.n_tokens == len(r.ids) for r in out) and {r.doc_id for r in out} <= {1, 4, 5, None}


def test_pipeline_equals_a_plain_run(spark, sf):
    """The stages done one document at a time: scores of the trained model, equal and near texts, draws of the plan."""
    from corpusflow.llm import mixing, simhash, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect())
    score = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    rows = [r for r in rows if score(r[1]) < 0.5]
    seen, once = set(), []
    for r in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if norm not in seen:
            once.append(r)
        seen.add(norm)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t, _ in once]
    fps = [simhash.fingerprint(t, 5) for _, t, _ in once]
    parent = list(range(len(once)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(once)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    left = [r for i, r in enumerate(once) if find(i) == i]
    df = spark.createDataFrame(left, "doc_id long, text string, source string")
    plan = {r.source: r.target / r.source_size for r in mixing.targets(df.select("source", mixing.size_of().alias("size"))).collect() if r.source_size}
    draw = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform().alias("u")).collect()}
    want = Counter()
    for i, _, source in left:
        rate = plan.get(source, 0.0)
        want[i] = int(rate) + (draw[i] < rate - int(rate))
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == +want and len(left) < len(once) < len(rows)
