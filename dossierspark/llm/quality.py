"""Operator 4: text quality by histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text in the tasks. The trees are fitted on the driver from a
bounded sample of labelled documents (SAMPLE_ROWS, those of smallest hash of the id), flattened into
arrays (feature, threshold bin, leaf values by level order) and traversed for all rows at once.

A null text counts as empty; empty texts are scored like any other, very long ones as a whole. With no
usable labels, or labels of one kind only, the score is the (smoothed) share of label 1. Repeated label
rows count once; where they contradict each other the larger label holds. Null labels and labels of
unknown documents are ignored. Equal texts have equal scores, repeated rows stay, an empty table gives an
empty one. Other columns of documents are never read by a score, whatever their names; accepted() keeps
them, score_quality() leaves them out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE_ROWS = 16_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 80, 4, 64, 0.15, 4.0, 1.0
NAMES = [
    "log_chars", "log_words", "log_lines", "word_mean", "word_max", "word_var", "distinct_words", "top_word",
    "top_three", "repeats_next", "distinct_pairs", "distinct_lines", "line_mean", "upper", "lower", "digit", "space",
    "other_ascii", "non_ascii", "ends_mark", "end_kinds", "bang_words", "stop_ends", "upper_words", "bars", "markup",
    "distinct_thirds", "byte_entropy", "pair_cover",
]
_CLASS = np.full(256, 4)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 5
_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff.,;:?]+\s")


def statistics(text: str | None) -> list[float]:
    """The numbers that the trees see, for one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, lines = len(words), [x for x in data.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_CLASS, counts, 6) / max(1, len(data))
    p = counts[counts > 0] / max(1, len(data))
    if not n:
        return [np.log1p(len(data)), 0.0, 0.0] + [0.0] * (len(NAMES) - 3)
    lengths = np.fromiter(map(len, words), np.int64, n)
    freq = Counter(words)
    top = [c for _, c in freq.most_common(3)]
    pairs = Counter(zip(words, words[1:]))
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        np.log1p(len(data)),
        np.log1p(n),
        np.log1p(len(lines)),
        lengths.mean(),
        float(lengths.max()),
        lengths.std(),
        len(freq) / n,
        top[0] / n,
        sum(top) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(pairs) / max(1, n - 1),
        len(set(lines)) / len(lines),
        line_lengths.mean(),
        *share,
        len(_MARKS.findall(data)) / n,
        len({w[-1] for w in freq}),
        data.count(b"!! ") / n,
        (data.count(b". ") + data.count(b".\n")) / n,
        sum(c for w, c in freq.items() if w.isupper()) / n,
        data.count(b" | ") / n,
        (data.count(b"<") + data.count(b"{")) / n,
        len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
        float(-(p * np.log2(p)).sum()),
        sum(c for c in pairs.values() if c > 1) / max(1, n - 1),
    ]


@dataclass
class Trees:
    """Trees of one depth as arrays: node i has children 2i+1 and 2i+2, leaves follow the nodes."""

    edges: np.ndarray  # upper bin edges by feature
    feature: np.ndarray  # tree x node
    cut: np.ndarray  # tree x node: right if the bin is greater
    leaf: np.ndarray  # tree x leaf
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.leaf) and len(x):
            b, rows = self.bins(x), np.arange(len(x))
            inner = self.feature.shape[1]
            for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
                at = np.zeros(len(x), np.int64)
                for _ in range(inner.bit_length()):
                    at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
                total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting on the logistic loss; gradients are summed into histograms by node and bin."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    width = x.shape[1]
    inner = (1 << DEPTH) - 1
    none = np.zeros((0, inner), np.int64)
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((width, 0)), none, none, np.zeros((0, inner + 1)), base)
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    model = Trees(edges, none, none, np.zeros((0, inner + 1)), base)
    b = model.bins(x).astype(np.int64)
    total, features, cuts, leaves = np.full(len(y), base), [], [], []
    columns = np.arange(width) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = (1 << level) - 1, 1 << level
            cell = (((at - first) * width * BINS)[:, None] + columns + b).ravel()
            shape = (nodes, width, BINS)
            left_g = np.bincount(cell, np.repeat(g, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            left_h = np.bincount(cell, np.repeat(h, width), nodes * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST_WEIGHT) | (all_h - left_h < LEAST_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            worth = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature[first : first + nodes] = np.where(worth, best // BINS, 0)
            cut[first : first + nodes] = np.where(worth, best % BINS, BINS)
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        sum_g, sum_h = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = -RATE * sum_g / (sum_h + RIDGE)
        total += leaf[at - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(edges, np.array(features), np.array(cuts), np.array(leaves), base)


def remainder(modulus: int):
    """crc32 of the id as text, modulo `modulus` (null for a null id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled ids: those of smallest hash, whatever their order."""
    bounded_batches(docs.sparkSession)
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame) -> Trees:
    """Fit on labels whose remainder mod 3 is not 1."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["label"], batch["doc_id"]], ["x", "label", "doc_id"])

    sample = labelled_sample(docs, labels.where(remainder(3) != 1), "quality", SAMPLE_ROWS)
    rows = sample.mapInArrow(features, "x array<double>, label int, doc_id long").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")  # the order of tasks must not change the fit
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(NAMES))
    return fit_trees(x, rows["label"].to_numpy(np.float64))


#: Texts whose statistics are worked out before the trees see them, whatever the size of Arrow batches.
SCORE_ROWS = 1000


def score_of(docs: DataFrame, model: Trees):
    """The score of a text column as a UDF: texts go to Python, only a number comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for lo in range(0, len(text), SCORE_ROWS):
            x = [statistics(t.as_py()) for t in text.slice(lo, SCORE_ROWS)]
            out[lo : lo + len(x)] = shared.value.score(np.array(x, np.float64).reshape(len(x), len(NAMES)))
        return pa.array(out)

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(docs, model)("text").alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; no shuffle of texts."""
    return docs.where(score_of(docs, fit_quality(docs, labels))("text") >= 0.5)
