import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import langid, quality, toxicity
from corpusflow.llm.queries import op1_toxicity, op2_quality, op8_langid
from corpusflow.llm.sampling import bounded, fold

ODD = [(None, None), (-1, ""), (-2, "12 34 !!"), (-3, "long text " * 40_000), (-3, "long text " * 40_000)]


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return float((s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean())


def judged(spark, query, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return query(spark, sf).where("held_out").join(labels, "doc_id").select(label, "score", "predicted").toPandas()


def test_toxicity_on_held_out_rows(spark):
    r = judged(spark, op1_toxicity, "toxic")
    assert auc(r.toxic, r.score) > 0.95
    assert (r.predicted[r.toxic == 0] == 0).mean() > 0.98 and (r.predicted[r.toxic == 1] == 1).mean() > 0.85


def test_quality_on_held_out_rows(spark):
    r = judged(spark, op2_quality, "quality")
    assert auc(r.quality, r.score) > 0.97 and (r.predicted == r.quality).mean() > 0.97


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    r = op8_langid(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.99 and r.score.between(0, 1).all()


def test_swapping_identity_terms_leaves_the_score(spark):
    """Toxic texts mention one group more often; the penalty takes that out of the score."""
    rng = np.random.default_rng(0)
    words = ["table", "river", "stone", "cloud", "paper", "green"]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        base = list(rng.choice(words, 6)) + (["vile"] if toxic and rng.random() < 0.9 else [])
        base.append("muslim" if rng.random() < (0.7 if toxic else 0.1) else "christian")
        texts.append(" ".join(base))
        labels.append(toxic)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "doc_id long, toxic int")
    plain, fair = (toxicity.train(docs, marks, penalty=p) for p in (0.0, 50.0))
    gap = lambda m: abs(m.scorer()("a muslim family by the river") - m.scorer()("a christian family by the river"))
    assert gap(fair) < 0.2 * gap(plain) and fair.scorer()("you vile muslim") > 0.5 and fair.swapped >= 400


def test_counterfactuals_swap_one_term_of_a_sentence(spark):
    swaps = {"women": "men", "men": "women"}
    texts = ["Women and men talk. Women sing! nobody", "women and men talk", None, ""]
    chosen = sorted(toxicity.parts("women") | toxicity.parts("men") | toxicity.parts("sing"))
    gram, n = toxicity.counterfactuals(spark.createDataFrame([(t,) for t in texts], "text string"), swaps, chosen)
    want, m = np.zeros((len(chosen), len(chosen))), 0
    for sentence in ("women and men talk", "women sing", "women and men talk"):
        own = set(sentence.split())
        for term in own & swaps.keys():
            before, after = (set().union(*map(toxicity.parts, ws)) for ws in (own, own - {term} | {swaps[term]}))
            d = np.array([(p in after) - (p in before) for p in chosen])
            want, m = want + np.outer(d, d), m + 1
    assert n == m == 5 and (gram == want).all() and gram.any()


def test_the_penalty_acts_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    plain, fair = (toxicity.train(docs, labels, penalty=p) for p in (0.0, toxicity.PENALTY))
    assert plain.swapped == fair.swapped > 1000 and len(fair.swaps) > len(toxicity.SWAP)
    of = lambda m, w: sum(m.weights.get(p, 0) for p in toxicity.parts(w))
    moved = lambda m: sum((of(m, w) - of(m, o)) ** 2 for w, o in fair.swaps.items() if w not in toxicity.SWAP)
    assert moved(plain) > 0.01 and moved(fair) < 0.25 * moved(plain)
    naive = lambda t: 1 / (1 + np.exp(-np.clip(fair.bias + sum(fair.weights.get(p, 0) for p in {q for w in toxicity.words_of(t) for q in toxicity.parts(w)}), -30, 30)))
    some = docs.where("doc_id < 300").select("doc_id", "text")
    assert all(abs(r.score - naive(r.text)) < 1e-9 for r in toxicity.score(some, fair).collect())


def test_statistics_against_a_plain_count():
    text = "One two two.\nTHREE | 44!\n\nOne two two."
    got = dict(zip(quality.FEATURES, quality.statistics(text), strict=True))
    words, n = text.split(), len(text.encode())
    assert np.isclose(got["log_words"], np.log1p(len(words))) and np.isclose(got["log_chars"], np.log1p(n)) and np.isclose(got["word_len"], np.mean([len(w) for w in words]))
    assert got["upper"] == sum(c.isupper() for c in text) / n and got["digit"] == 2 / n and got["bar"] == 1 / n and got["newline"] == 3 / n
    assert got["distinct_words"] == len(set(words)) / len(words) and got["top_word"] == 2 / len(words) and got["upper_words"] == 1 / len(words)
    assert got["lines"] == 3 / len(words) and np.isclose(got["dup_lines"], 1 - 2 / 3) and got["end_marks"] == 1.0
    pairs = list(zip(words, words[1:], strict=False))
    assert np.isclose(got["dup_pairs"], 1 - len(set(pairs)) / len(pairs)) and quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.FEATURES)


def test_language_equals_a_plain_average():
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 0.7, 0.2)
    letters = langid._letters()
    for text in ("Hello, world", "été 12 漢字", "x", "ab" * 500):
        grams = np.concatenate(list(langid.ngram_blocks(text, letters)))
        z = (np.mean([model.table[g].astype(float) for g in grams], axis=0) + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        name, score, rejected = model.predict(text, letters)
        assert name == "abc"[int(p.argmax())] and np.isclose(score, p.max()) and rejected == (p.max() < 0.2)
    # One border before and after each word, n-grams of one to four characters.
    word = " hi "
    n = sum(len(word) - k + 1 for k in langid.ORDERS)
    assert len(np.concatenate(list(langid.ngram_blocks("hi!", letters)))) == n


def test_forest_traversal_equals_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    f = quality.fit(x, y, trees=30, depth=3)
    assert ((f.predict(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.threshold[t, node])
            total += f.leaf[t, node - f.feature.shape[1]]
        return total

    assert np.allclose(f.raw(x[:40]), [walk(r) for r in x[:40]])
    assert np.isfinite(quality.fit(x, np.ones(500)).predict(x)).all() and len(quality.fit(x[:0], y[:0]).predict(x)) == 500


def test_odd_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in ODD], "doc_id long, text string, score string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tox = toxicity.score(df, toxicity.train(df, none)).collect()
    assert len(tox) == 5 and all(0 <= r.score <= 1 and r.toxic == 1 for r in tox)
    qual = quality.score(df, quality.train(df, none)).collect()
    assert len(qual) == 5 and all(0 <= r.score <= 1 for r in qual)
    lang = langid.predict(df, langid.train(df.withColumn("lang", F.lit("en")))).collect()
    by = {r.doc_id: r for r in lang}
    assert len(lang) == 5 and by[None].lang_pred == by[-1].lang_pred == by[-2].lang_pred == "und" and by[-3].lang_pred == "en"
    empty = df.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0 == langid.predict(empty, langid.train(empty.withColumn("lang", F.lit("en")))).count()


def test_samples_are_exact_and_fixed(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = (sorted(r.doc_id for r in bounded(df.repartition(n), 500).collect()) for n in (3, 8))
    assert a == b and len(a) == 500 and bounded(df, 9000).count() == 5000
    # Repeated and null ids: rows are told apart by their texts, equal ones count once.
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 2000).cast("string")).alias("text"))
    one = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("text"))
    both = same.unionByName(one)
    assert bounded(both, 700).count() == 700 and bounded(both, 10_000).count() == 5000
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, label int")
    got = bounded(both, 700, labels).collect()
    assert len(got) == 700 and {r.doc_id for r in got} == {7} and bounded(both, 10, labels.limit(0)).count() == 0
    import zlib

    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in df.select("doc_id", fold(5).alias("f")).collect())
