"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed character n-grams (1 to 4
letters, word borders included); a linear layer and a softmax give the language.
Both are trained by stochastic gradient descent in numpy.  A held-back part of
the sample calibrates a temperature and the score below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.sampling import bounded
from corpusflow.runtime import text_batches

SAMPLE = 2_500
BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3, 4)
BLOCK = 1 << 18
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_blocks(text: str | None, letters: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-grams of the letters of a text, block by block; nothing without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(codes), BLOCK):  # bounded memory for very long texts
        block = codes[at : at + BLOCK]
        is_letter = letters[block]
        if not is_letter.any():
            continue
        keep = is_letter | np.concatenate([[False], is_letter[:-1]])  # one border after each word
        word = np.concatenate([[32], np.where(is_letter, block, 32)[keep]]).astype(np.uint64)
        out, h = [], np.zeros(len(word), np.uint64)
        for n in ORDERS:
            h = h[: len(word) - n + 1] * np.uint64(0x100000001B3) + word[n - 1 :] + np.uint64(n)
            if not len(h):
                break
            mixed = h * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed >> np.uint64(40)) % np.uint64(buckets))
        yield np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """``table`` holds each bucket's embedding times the linear layer, so a text's logits are an average of its rows."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, bool]:
        """Language, its calibrated probability, and whether it is too low to be trusted."""
        total, n = np.zeros(len(self.languages)), 0
        for grams in ngram_blocks(text, letters):
            total += self.table[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        if not n or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax((total / n + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 5, batch: int = 32, rate: float = 12.0, seed: int = 7) -> Model:
    """Fit on bags of ``(bucket, count)`` arrays with their languages."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in langs])
    emb = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    w, b = rng.normal(0, 0.5, (DIM, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(bags))
    held, used = order[: len(bags) // 5], order[len(bags) // 5 :]

    shares = [(n / n.sum()).astype(np.float32) for _, n in bags]

    def hidden(rows: np.ndarray) -> np.ndarray:
        return np.array([shares[i] @ emb[bags[i][0]] for i in rows]).reshape(-1, DIM)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rows_in_turn = rng.permutation(used)
        for at in range(0, len(used), batch):
            rows = rows_in_turn[at : at + batch]
            h = hidden(rows)
            grad = softmax(h @ w + b)
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad /= len(rows)
            back = grad @ w.T
            w -= step * 0.1 * h.T @ grad
            b -= step * 0.1 * grad.sum(axis=0)
            for i, g in zip(rows, back, strict=True):
                emb[bags[i][0]] -= (step * shares[i])[:, None] * g
    z = np.concatenate([np.zeros((0, len(languages)))] + [hidden(held) @ w + b])
    grid = np.geomspace(0.05, 4, 40)
    losses = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() if len(held) else t for t in grid]
    temperature = float(grid[int(np.argmin(losses))]) if len(held) else 1.0
    tops = np.sort(softmax(z / temperature).max(axis=1)) if len(held) else np.array([0.5])
    return Model(languages, (emb @ w).astype(np.float32), b, temperature, float(min(0.5, tops[len(tops) // 200])))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` distinct rows with a language; their whole texts are turned into bags of at most ``BUCKETS`` counts on the executors."""
    known = docs.where("lang is not null and text is not null")
    chosen = bounded(known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for rows in batches:
            grams, counts, kept = [], [], []
            for i, text in enumerate(rows.column("text")):
                total = np.zeros(BUCKETS, np.int32)
                for block in ngram_blocks(text.as_py(), letters):
                    total += np.bincount(block, minlength=BUCKETS).astype(np.int32)
                found = np.flatnonzero(total)
                if len(found):
                    grams.append(found.astype(np.int32))
                    counts.append(total[found])
                    kept.append(i)
            kind, at = pa.list_(pa.int32()), pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rows.column("hash").take(at), rows.column("lang").take(at), pa.array(grams, kind), pa.array(counts, kind)], names=["hash", "lang", "g", "n"]
            )

    got = chosen.select("hash", "lang", "text").mapInArrow(run, "hash long, lang string, g array<int>, n array<int>").toArrow().sort_by("hash")  # a bounded sample
    lists = [
        (g.values.to_numpy(), n.values.to_numpy()) for g, n in zip(got.column("g"), got.column("n"), strict=True)
    ]
    return fit(lists, got.column("lang").to_pylist())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row, over whole texts.

    A null text, or one without letters, is ``und`` with score 0.  ``rejected``
    marks scores under the calibrated threshold; the language is named all the
    same.  Repeated rows repeat; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letters = shared.value, _letters()
        for batch in batches:
            found = [own.predict(t.as_py(), letters) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
