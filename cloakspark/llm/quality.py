"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed in Arrow batches. Trees are grown level by level over histograms of
binned statistics (logistic loss, second-order gains), each as a complete binary tree, and flattened into three
arrays: feature and threshold of inner nodes, value of leaves. A batch is scored by stepping all its rows
through all trees at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cloakspark.llm._common import held_out, labelled, map_batches, table, texts_of

#: Labelled documents that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: A document is kept from this score on.
KEEP_FROM = 0.3
MODULUS, REST = 5, 0
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
LEAST_WEIGHT, SHRINK = 4.0, 1.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
STATISTICS = (
    "bytes", "words", "lines", "mean_word", "longest_word", "distinct_words", "top_word", "same_as_next", "distinct_lines", "mean_line",
    "upper", "lower", "digits", "spaces", "stops", "exclaim", "pipes", "symbols", "other_punct", "beyond_ascii", "entropy", "short_words", "capital_words", "marked_words",
)


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text, in the order of STATISTICS; all are finite, also for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw) or 1
    h = np.bincount(raw, minlength=256).astype(float)
    words, lines = text.split(), text.split("\n")
    counts = Counter(words)
    w = len(words) or 1
    lengths = [len(x) for x in words] or [0]
    p = h[h > 0] / n
    at = lambda s: float(h[list(s)].sum()) / n
    punct = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    symbols = at(b"#$%&*@^~_=+<>{}[]\\")
    return [
        float(len(raw)), float(len(words)), float(len(lines)), sum(lengths) / w, float(max(lengths)), len(counts) / w, max(counts.values(), default=0) / w,
        sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines), len(raw) / len(lines), h[65:91].sum() / n, h[97:123].sum() / n, h[48:58].sum() / n, at(b" \t\n\r"),
        at(b".,;:"), at(b"!?"), at(b"|"), symbols, punct / n - symbols, h[128:].sum() / n, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        sum([x <= 2 for x in lengths]) / w, sum(map(str.isupper, words)) / w, sum([not x[-1].isalnum() for x in words]) / w,
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: inner nodes of tree t at [t, 0..2^depth-1), leaves at [t, 0..2^depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        inner, t = self.feature.shape[1], np.arange(len(self.feature))
        node = np.zeros((len(x), len(t)), np.int64)
        rows = np.arange(len(x))[:, None]
        while len(t) and inner and node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        z = np.full(len(x), self.base)
        if len(t):
            z += self.leaf[t, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for rows x and 0/1 labels y. Without both labels: no trees, and the mean (0.5 if no rows) as score."""
    n, width = len(x), len(STATISTICS)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    inner = 2**DEPTH - 1
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    cells = bins + BINS * np.arange(width)
    z = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (width * BINS) + cells).ravel()
            sums = [np.bincount(where, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS) for v in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + SHRINK)
        z = z + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def fitted(spark: SparkSession, sf_dir: str) -> Trees:
    """Trees fitted on at most TRAIN_ROWS labelled documents outside the held-out fold."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64())), batch.column("y")], ["doc_id", "x", "y"])

        return each

    rows = map_batches(labelled(spark, sf_dir, "quality", MODULUS, REST, TRAIN_ROWS), make, "doc_id long, x array<double>, y int").toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, np.array(rows["y"].to_pylist(), float))


def scored(df: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts count as empty, null ids pass through as not held out.

    Rows are scored one by one, so repeated rows get equal scores; columns other than doc_id and text aren't read.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = trees.score(np.array([statistics(t) for t in texts_of(batch)]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= KEEP_FROM).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

        return each

    rows = df.select(df["doc_id"].cast("long").alias("doc_id"), held_out("doc_id", MODULUS, REST).alias("held_out"), df["text"].cast("string").alias("text"))
    return map_batches(rows, make, SCHEMA)


def kept(df: DataFrame, trees: Trees) -> DataFrame:
    """The rows of `df` whose text scores KEEP_FROM or more, with all their columns."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(trees.score(np.array([statistics(t) for t in texts_of(batch)])) >= KEEP_FROM))

        return each

    return map_batches(df, make, df.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole document."""
    return scored(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
