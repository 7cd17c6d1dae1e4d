"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics of a whole text (bytes by class, words, repeated words, lines) are computed where the
text is; they are binned at quantiles of the training sample, and trees are grown level by level
from gradient histograms. A fitted model is a few arrays; a batch descends all trees at once.

The model is fitted on the driver from about ``rows`` labelled documents at most (their statistics,
not their texts); scoring reads every document once and shuffles nothing. Null and empty
texts have statistics of zero and are scored like any other. With no labels, or labels of
one kind, every score is the share of label 1 (0.5 if none).
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.labelled import held_out, sample
from cohortlake.llm.words import binary_texts

ROWS, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 60, 4, 64, 0.15, 1.0, 10
THRESHOLD = 0.3
NAMES = (
    "log_bytes log_words word_length upper lower digit space mark symbol high distinct_words top_word "
    "same_neighbour marked_words upper_words log_lines line_length distinct_lines short_lines byte_entropy top_byte"
).split()
BYTE_CLASSES = np.array([
    [chr(b).isascii() and chr(b).isupper(), chr(b).isascii() and chr(b).islower(), 48 <= b <= 57, b in b" \t\n\r\v\f",
     chr(b) in ".,;:!?'\"()-", chr(b) in "$%&#*@^~|<>{}[]=+_/\\`", b >= 128]
    for b in range(256)
], np.float64)
MARKS = b".,;:!?'\"()-$%&#*@^~|<>{}[]=+_/\\`"


def statistics(text: bytes | None) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    size = len(text)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    some = share[share > 0]
    words, lines = text.split(), text.split(b"\n")
    n = max(len(words), 1)
    counts = Counter(words)
    return [
        np.log1p(size), np.log1p(len(words)), size / n, *(share @ BYTE_CLASSES), len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n,
        sum(len(w) - len(w.rstrip(MARKS)) > 1 for w in words) / n, sum(map(bytes.isupper, words)) / n,
        np.log1p(len(lines)), size / len(lines), len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines), -float(some @ np.log2(some)), float(share.max()),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))


class Trees:
    """Boosted trees as arrays of shape (trees, nodes); node i has children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.limit, self.value = base, feature, limit, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, bins=BINS, rate=RATE, ridge=RIDGE, least=LEAST) -> Trees:
        inner, n = 2**depth - 1, len(y)
        feature, limit = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
        value = np.zeros((trees, 2**depth))
        share = y.mean() if n else 0.5
        if not n or not 0 < share < 1:
            return cls(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20), feature, limit, value)
        cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
        binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)])
        raw = np.full(n, base := float(np.log(share / (1 - share))))
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess, node = p - y, np.maximum(p * (1 - p), 1e-9), np.zeros(n, np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                gain, where, at = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
                for j, column in enumerate(binned):
                    cell = (node - first) * bins + column
                    g, h, c = (
                        np.bincount(cell, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (grad, hess, None)
                    )
                    full_g, full_h, full_c = g[:, -1:], h[:, -1:], c[:, -1:]
                    better = g**2 / (h + ridge) + (full_g - g) ** 2 / (full_h - h + ridge) - full_g**2 / (full_h + ridge)
                    better[(c < least) | (full_c - c < least)] = 0
                    better[:, len(cuts[j]):] = 0
                    best = better.argmax(axis=1)
                    improves = better[np.arange(width), best] > gain
                    gain = np.where(improves, better[np.arange(width), best], gain)
                    where, at = np.where(improves, j, where), np.where(improves, best, at)
                for k in np.flatnonzero(at >= 0):
                    feature[t, first + k], limit[t, first + k] = where[k], cuts[where[k]][at[k]]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
            value[t] = -rate * g / (h + ridge)
            raw += value[t, leaf]
        return cls(base, feature, limit, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), np.int64)
        while inner and len(x) and node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - inner].sum(axis=1))))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", parts: int = 5, part: int = 0, rows: int = ROWS, **shape) -> Trees:
    """Trees for about ``rows`` labelled documents outside the held-out part."""
    chosen = sample(docs, labels, label, parts, part, rows)

    def scan(batches):
        for batch in batches:
            found = matrix(binary_texts(batch, "text"))
            values = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(NAMES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([values, batch.column(1)], names=["x", "label"])

    seen = chosen.mapInArrow(scan, "x array<double>, label int").toPandas()
    x = np.array(seen["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    y = seen["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # sums in one order, whatever task was first
    return Trees.fit(x[order], y[order], **shape)


def scores(docs: DataFrame, model: Trees, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row. Other columns are not read."""
    parts = vars(model)

    def scan(batches):
        trees = Trees(**parts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(trees.score(matrix(binary_texts(batch, "text"))))], names=["doc_id", "score"]
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, *, parts: int = 5, part: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels, parts=parts, part=part, **options)
    return scores(docs, model).select(
        "doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Trees, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, all columns as they are."""
    parts = vars(model)

    def keep(batches):
        trees = Trees(**parts)
        for batch in batches:
            yield batch.filter(pa.array(trees.score(matrix(binary_texts(batch, text))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
