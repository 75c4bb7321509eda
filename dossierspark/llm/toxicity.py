"""Operator 6: toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their beginnings of 3 to 7 characters, hashed to
64 bits. A second-order factorization machine adds to linear weights a product of factors for
every pair of terms that occur together, so that an insult beside a group's name can weigh more than
both alone. It is fitted on the driver from a bounded sample of labelled documents (SAMPLE_ROWS, those
of smallest hash of the id), over at most TERMS terms: those whose presence tells most about the label
in the sample (equal terms of information by hash). Terms are counted and chosen in the tasks; the driver
gets their hashes and the numbers of each document's chosen terms. Scoring needs one pass over the texts
and one dictionary of bounded size.

A null text counts as empty; empty texts have the bias as their score, very long ones are read as a
whole. With no usable labels, or labels of one kind, the score is the smoothed share of label 1. Repeated
label rows count once, the larger label holds. Equal texts have equal scores, repeated rows stay, an
empty table gives an empty one. Other columns of documents are left aside, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, written
from .decontaminate import words_of
from .quality import labelled_sample, remainder

SAMPLE_ROWS = 16_000
TERMS, FACTORS, ROUNDS, BATCH, RATE, RIDGE, SEED = 4096, 8, 20, 256, 0.1, 1e-4, 7
LEAST_DOCS = 3


def terms_of_word(word: bytes) -> list[int]:
    """A word, and its first 3 to 7 characters as far as it has them."""
    text = word.decode("utf-8", "replace")
    starts = [b"^" + text[:k].encode() for k in range(3, 8) if len(text) >= k]
    return [xxhash.xxh3_64_intdigest(t) for t in (word, *starts)]


@dataclass
class Machine:
    terms: np.ndarray  # sorted hashes
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # term x FACTORS

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows given as (row, number of term) pairs of present terms."""
        out = np.full(n, self.bias)
        if len(rows):
            out += np.bincount(rows, self.weight[terms], n)
            v = self.factor[terms]
            for k in range(v.shape[1]):
                out += 0.5 * (np.bincount(rows, v[:, k], n) ** 2 - np.bincount(rows, v[:, k] ** 2, n))
        return out


def choose_terms(sample: DataFrame) -> np.ndarray:
    """The terms with the largest information about the label (two-sided G statistic), sorted.

    sample: terms array<long>, label. Terms are counted in the tasks; only the chosen ones are sent.
    """
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = (
        sample.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").cast("double").alias("c"), F.sum("label").cast("double").alias("a"))
        .where(F.col("c") >= LEAST_DOCS)
    )
    c, a = F.col("c"), F.col("a")

    def part(seen, expected):
        return seen * F.log(F.greatest(seen, F.lit(1e-12)) / F.greatest(expected, F.lit(1e-12)))

    share = pos / max(1, n)
    g = part(a, c * share) + part(c - a, c * (1 - share)) + part(pos - a, (n - c) * share) + part(n - pos - c + a, (n - c) * (1 - share))
    best = counted.select("term", F.round(g, 9).alias("g")).orderBy(F.desc("g"), "term").limit(TERMS)
    return np.sort(best.toArrow()["term"].to_numpy().view(np.uint64))


def fit_machine(terms: np.ndarray, present: list[np.ndarray], y: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss over the chosen terms; present: numbers of the terms of each document."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Machine(np.zeros(0, np.uint64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(SEED)
    m = Machine(terms, bias, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)))
    seen_w, seen_v, seen_b = np.full(len(terms), 1e-6), np.full(m.factor.shape, 1e-6), 1e-6
    for _ in range(ROUNDS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            at = order[lo : lo + BATCH]
            t = np.concatenate([present[i] for i in at])
            r = np.repeat(np.arange(len(at)), [len(present[i]) for i in at])
            slope = 1 / (1 + np.exp(-m.raw(r, t, len(at)))) - y[at]
            v = m.factor[t]
            sums = np.column_stack([np.bincount(r, v[:, k], len(at)) for k in range(FACTORS)])
            used, inv = np.unique(t, return_inverse=True)
            gw = np.bincount(inv, slope[r], len(used)) / len(at) + RIDGE * m.weight[used]
            gv = slope[r][:, None] * (sums[r] - v)
            gv = np.column_stack([np.bincount(inv, gv[:, k], len(used)) for k in range(FACTORS)]) / len(at) + RIDGE * m.factor[used]
            gb = slope.mean()
            seen_w[used] += gw**2
            seen_v[used] += gv**2
            seen_b += gb**2
            m.weight[used] -= RATE * gw / np.sqrt(seen_w[used])
            m.factor[used] -= RATE * gv / np.sqrt(seen_v[used])
            m.bias -= RATE * gb / np.sqrt(seen_b)
    return m


def _distinct_terms(memo: Memo, text: str | None) -> list[int]:
    out: set[int] = set()
    for w in set(words_of(text)):
        out.update(memo[w])
    return sorted(out)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on labels whose remainder mod 5 is not 0."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(terms_of_word)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                rows = [np.array(_distinct_terms(memo, t.as_py()), np.uint64).view(np.int64) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), part["label"], part["doc_id"]], ["terms", "label", "doc_id"])

    sample = labelled_sample(docs, labels.where(remainder(5) != 0), "toxic", SAMPLE_ROWS)
    sample = written(sample.mapInArrow(terms, "terms array<long>, label int, doc_id long"), "terms")
    chosen = choose_terms(sample)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every document the numbers of its chosen terms: at most TERMS short integers."""
        for batch in batches:
            rows = [np.flatnonzero(np.isin(shared.value, np.array(t.as_py(), np.int64).view(np.uint64), assume_unique=True)) for t in batch["terms"]]
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary()), batch["label"], batch["doc_id"]], ["terms", "label", "doc_id"])

    rows = sample.mapInArrow(numbers, "terms binary, label int, doc_id long").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    present = [np.frombuffer(t.as_py(), "<u2").astype(np.int64) for t in rows["terms"]]
    return fit_machine(chosen, present, rows["label"].to_numpy().astype(np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {int(t): i for i, t in enumerate(m.terms)}
        memo = Memo(lambda w: [number[t] for t in terms_of_word(w) if t in number], most=500_000)
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                batch = whole.slice(lo, 1000)
                rows, terms = [], []
                for i, text in enumerate(batch["text"]):
                    here: set[int] = set()
                    for found in filter(None, map(memo.__getitem__, set(words_of(text.as_py())))):
                        here.update(found)
                    terms += sorted(here)
                    rows += [i] * len(here)
                raw = m.raw(np.array(rows, np.int64), np.array(terms, np.int64), len(batch))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(1 / (1 + np.exp(-raw)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
