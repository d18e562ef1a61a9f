"""Quality: histogram gradient-boosted trees over document statistics.

The fitted trees are complete binary trees of one depth, flattened into three
arrays (feature, threshold, leaf value), so that a block of documents goes down
all trees at once with numpy indexing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.sampling import bounded
from corpusflow.runtime import text_batches

SAMPLE = 20_000
FEATURES = (
    "log_chars", "log_words", "word_len", "upper", "digit", "other_byte", "space", "newline", "full_stop", "comma", "exclaim", "bar",
    "symbol", "quote_dash", "slash_colon", "distinct_words", "top_word", "symbol_words", "upper_words", "long_words", "short_words",
    "lines", "line_len", "dup_lines", "dup_pairs", "end_marks", "zip_ratio",
)
_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "other_byte": bytes(range(128, 256)), "space": b" \t\r\x0b\x0c", "newline": b"\n",
    "full_stop": b".?", "comma": b",;", "exclaim": b"!", "bar": b"|", "symbol": b"#$%&*+<=>@[]\\^_`{}~", "quote_dash": b"\"'()-", "slash_colon": b"/:",
}


def statistics(text: str | None) -> list[float]:
    """The document statistics of ``FEATURES``; all 0 for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), len(raw)
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    per_byte = [float(hist[list(chars)].sum()) / n for chars in _BYTES.values()]
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    upper = sum(map(bytes.isupper, words))
    plain = sum(w.rstrip(b".,;:!?").isalpha() or not w.isascii() for w in counts)
    pairs = len(set(zip(words, words[1:], strict=False)))
    squeezed = sum(len(zlib.compress(raw[at : at + 65536], 1)) for at in range(0, n, 65536))
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(lengths.mean()), *per_byte, len(counts) / m, max(counts.values()) / m, 1 - plain / len(counts),
        upper / m, float((lengths > 15).mean()), float((lengths < 3).mean()), len(lines) / m, float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, m - 1), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        squeezed / n,
    ]


@dataclass
class Forest:
    """``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees, leaves); node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        inner = self.feature.shape[1]
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        while inner and node[0, 0] < inner if len(trees) and len(x) else False:
            f = self.feature[trees, node]
            node = 2 * node + 1 + (x[rows, f] > self.threshold[trees, node])
        return self.base + (self.leaf[trees, node - inner].sum(axis=1) if len(trees) and len(x) else np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, least: float = 3.0, ridge: float = 1.0) -> Forest:
    """Boost depth-limited trees on the logistic loss from per-node histograms of binned features.

    With one class only, or no rows, the forest has no trees and a constant score.
    """
    share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, n_features = 2**depth - 1, x.shape[1]
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total, kept = np.full(len(y), base), ([], [], [])
    offsets = np.arange(n_features) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * n_features * bins + offsets + binned).ravel()
            g, h = (
                np.bincount(cell, np.repeat(v, n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(axis=2)
                for v in (grad, hess)
            )
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                f, cut = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-6 and cut < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        place = node - inner
        leaf = -rate * np.bincount(place, grad, inner + 1) / (np.bincount(place, hess, inner + 1) + ridge)
        total = total + leaf[place]
        for out, v in zip(kept, (feature, threshold, leaf), strict=True):
            out.append(v)
    return Forest(*map(np.array, kept), base)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on the statistics of at most ``sample`` distinct rows with a label in ``labels.quality``; null labels are left out."""
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")), sample, marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("label"), values], names=["hash", "label", "x"])

    got = rows.select("hash", "label", "text").mapInArrow(run, "hash long, label int, x array<double>").toArrow().sort_by("hash")  # a bounded sample
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, (np.array(got.column("label").to_pylist()) > 0).astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with a ``score`` column (0 to 1) over every whole text; null and empty texts are scored as empty.

    An existing ``score`` column is replaced; rows and other columns are unchanged.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            values = pa.array(shared.value.predict(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "score"])

    base = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, score double")
