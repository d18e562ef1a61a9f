"""Toxicity: a logistic model over word parts, regularised by counterfactual swaps.

In labelled sentences, terms that name a group neutrally are swapped, one at a
time, for others of their kind; the loss penalises the squared change of the
score between a sentence and its counterfactual, so that neutral mentions do not
move it.  Terms are a given table and words of the labelled texts themselves:
those that toxic and clean texts hold at like rates, each swapped for the one
whose neighbours are most like its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.sampling import bounded
from corpusflow.runtime import stored, text_batches

#: Given identity terms; within a group each is swapped for the next.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("disabled", "blind", "deaf"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {group[i]: group[(i + 1) % len(group)] for group in IDENTITY for i in range(len(group))}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: At most this many labelled rows are fitted, with so many chosen parts and swappable words found in the texts.
SAMPLE = 5_000
FEATURES = 500
TERMS = 40
PENALTY = 10.0
CONTEXTS = 64


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def parts(word: str) -> set[int]:
    """Hashes of a word as such, of its beginnings and of its endings."""
    raw = word.encode("utf-8", "surrogatepass")
    n = len(raw)
    out = {crc32(raw, 1), *[crc32(raw[:k], 2) for k in range(3, min(n, 9))], *[crc32(raw[-k:], 3) for k in range(3, min(n, 7))]}
    return {h - (1 << 32) if h >> 31 else h for h in out}  # as signed 32-bit numbers


@dataclass
class Model:
    """Weights of the chosen parts; a text's score is the logistic of the bias plus the weights of its distinct parts."""

    weights: dict[int, float]
    bias: float
    swaps: dict[str, str] = field(default_factory=dict)
    #: Counterfactual sentences that the penalty was fitted on.
    swapped: int = 0

    def scorer(self):
        weights = self.weights
        known = weights.keys()

        class Memo(dict):
            def __missing__(self, word: str) -> frozenset[int] | None:
                if len(self) > 300_000:
                    self.clear()
                hit = self[word] = frozenset(parts(word) & known) or None
                return hit

        memo = Memo()

        def score(text: str | None) -> float:
            found: set[int] = set().union(*filter(None, map(memo.__getitem__, words_of(text))))
            z = self.bias + math.fsum(weights[p] for p in found)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(x: np.ndarray, y: np.ndarray, gram: np.ndarray, ridge: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of 0/1 features by Newton's method.

    The loss is ridge-penalised, plus ``w' gram w``: the squared changes of the
    score under the swaps.  With one class only, the bias says so.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 4.0 if len(y) and y[0] else -4.0
    x = np.hstack([x, np.ones((len(x), 1))])
    fixed, w = np.diag(np.append(np.full(x.shape[1] - 1, ridge), 1e-6)), np.zeros(x.shape[1])
    fixed[:-1, :-1] += gram
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + fixed + 1e-9 * np.eye(len(w)), x.T @ (p - y) + fixed @ w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def telling(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """``counts(a, b)`` with ``gain``, the G statistic of presence against the label, for ``n1`` toxic and ``n0`` clean rows."""
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    cells = ((F.col("a"), n1 * share), (F.col("b"), n0 * share), (n1 - F.col("a"), n1 * (1 - share)), (n0 - F.col("b"), n0 * (1 - share)))
    return counts.withColumn("gain", 2 * sum((F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0)))


def by_class() -> tuple[Column, Column]:
    return F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")


def best_parts(rows: DataFrame, n1: int, n0: int, features: int = FEATURES) -> list[int]:
    """The parts of toxic texts that tell most about the label, at most ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                found = np.fromiter(set().union(*map(parts, words_of(text.as_py()))), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), toxic.as_py()))], names=["part", "toxic"])

    counts = rows.select("text", "toxic").mapInArrow(run, "part int, toxic boolean").groupBy("part").agg(*by_class())
    found = telling(counts.where((F.col("a") + F.col("b") >= 3) & (F.col("a") * n0 > F.col("b") * n1)), n1, n0).where("gain > 15")
    return [r["part"] for r in found.orderBy(F.col("gain").desc(), "part").limit(features).collect()]


def neutral_words(rows: DataFrame, n1: int, n0: int, terms: int = TERMS, least: float = 0.02) -> list[str]:
    """The most frequent words that at least a share ``least`` of both classes hold, at rates that do not differ (G below 3.84)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counts = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(*by_class())
    often = counts.where((F.col("a") >= least * n1) & (F.col("b") >= least * n0))
    found = telling(often, n1, n0).where("gain < 3.84").orderBy((F.col("a") + F.col("b")).desc(), "word").limit(terms)
    return [r["word"] for r in found.collect()]


def like_contexts(rows: DataFrame, words: list[str]) -> dict[str, str]:
    """Each of the ``words`` with the other one whose neighbours, counted over all its occurrences, are most like its own."""
    if len(words) < 2:
        return {}
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(words), 2 * CONTEXTS), np.int64)
        for batch in batches:
            for text in batch.column(0):
                tokens = ["", *_WORD.findall((text.as_py() or "").lower()), ""]
                for i, w in enumerate(tokens):
                    if w in place:
                        counts[place[w], crc32(tokens[i - 1].encode("utf-8", "surrogatepass")) % CONTEXTS] += 1
                        counts[place[w], CONTEXTS + crc32(tokens[i + 1].encode("utf-8", "surrogatepass")) % CONTEXTS] += 1
        at, context = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(context), pa.array(counts[at, context])], names=["at", "context", "n"])

    got = rows.select("text").mapInArrow(run, "at long, context long, n long").groupBy("at", "context").agg(F.sum("n").alias("n")).toArrow()  # terms x contexts
    v = np.zeros((len(words), 2 * CONTEXTS))
    v[got.column("at").to_numpy(), got.column("context").to_numpy()] = got.column("n").to_numpy()
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    alike = np.round(v @ v.T, 9)
    np.fill_diagonal(alike, -1)
    return {w: words[int(alike[i].argmax())] for w, i in place.items()}


def difference(words: set[str], term: str, other: str, of) -> dict[int, int]:
    """How swapping ``term`` for ``other`` changes the parts (``of`` a word) of a sentence: 1 for a new one, -1 for one that goes."""
    rest = set().union(*(of(w) for w in words if w != term))
    before, after = rest | of(term), rest | of(other)
    return {p: 1 for p in after - before} | {p: -1 for p in before - after}


def counterfactuals(rows: DataFrame, swaps: dict[str, str], chosen: list[int]) -> tuple[np.ndarray, int]:
    """The sum of ``d d'`` over all counterfactual sentences, and their number; ``d`` is the change of the ``chosen`` parts.

    Every sentence of every row takes part, once for each distinct term in it.
    """
    size, place = len(chosen), {p: i for i, p in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n, memo = np.zeros((size, size), np.int64), 0, {}

        def of(word: str) -> frozenset[int]:
            if word not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[word] = frozenset(place[p] for p in parts(word) if p in place)
            return memo[word]

        for batch in batches:
            for text in batch.column(0):
                for sentence in _SENTENCE.split(text.as_py() or ""):
                    words = words_of(sentence)
                    for term in sorted(words & swaps.keys()):
                        d = difference(words, term, swaps[term], of)
                        at, by = np.fromiter(d.keys(), np.int64), np.fromiter(d.values(), np.int64)
                        gram[np.ix_(at, at)] += np.outer(by, by)
                        n += 1
        i, j = np.nonzero(gram)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i.tolist()]), pa.array([-1, *j.tolist()]), pa.array([n, *gram[i, j].tolist()])], names=["i", "j", "v"])

    got = rows.select("text").mapInArrow(run, "i long, j long, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # chosen parts squared at most
    gram, n = np.zeros((size, size)), 0
    for i, j, v in zip(*(got.column(c).to_pylist() for c in ("i", "j", "v")), strict=True):
        if i < 0:
            n = v
        else:
            gram[i, j] = v
    return gram, n


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, penalty: float = PENALTY, given: dict[str, str] | None = None) -> Model:
    """Fit on at most ``sample`` distinct rows of ``docs`` that have a label in ``labels.toxic``; null labels are left out.

    The penalty weighs the mean squared change over all counterfactual sentences
    of those rows against as many rows.  ``given`` terms (default: ``SWAP``) come
    before words found in the texts.  The driver gets counts and, of each row, only
    the chosen parts.
    """
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    found = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")), sample, marked)
    rows = stored(found.select("hash", "text", (F.col("label") > 0).alias("toxic")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return Model({}, 4.0 if n1 else -4.0)
    swaps = like_contexts(rows, neutral_words(rows, n1, n0)) | (SWAP if given is None else given)
    best = best_parts(rows, n1, n0, features)
    chosen = sorted({*best, *(p for pair in swaps.items() for w in pair for p in parts(w))})
    gram, swapped = counterfactuals(rows, swaps, chosen)
    active = np.flatnonzero(np.isin(chosen, best) | (np.diag(gram) > 0))  # parts of terms that no sentence holds are left out
    kept = [chosen[i] for i in active]
    place = {p: i for i, p in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [sorted({place[p] for w in words_of(t.as_py()) for p in parts(w) if p in place}) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("toxic"), pa.array(bags, pa.list_(pa.int32()))], names=["hash", "toxic", "bag"])

    got = rows.mapInArrow(run, "hash long, toxic boolean, bag array<int>").toArrow().sort_by("hash")  # a bounded sample
    x = np.zeros((got.num_rows, len(kept)))
    for row, bag in enumerate(got.column("bag").to_pylist()):
        x[row, bag] = 1
    y = got.column("toxic").to_numpy().astype(float)
    weights, bias = fit(x, y, gram[np.ix_(active, active)] * (penalty * len(y) / max(1, swapped)))
    return Model({int(p): float(v) for p, v in zip(kept, weights, strict=True)}, bias, swaps, swapped)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a ``score`` column (0 to 1) over every whole text; null counts as empty.

    An existing ``score`` column is replaced; rows and other columns are unchanged.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            values = pa.array([of(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "score"])

    base = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, score double")
