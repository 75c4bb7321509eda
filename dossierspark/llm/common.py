"""Shared pieces of the corpus operators: word splitting, hashing, caches, sorted groups."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import connected_components, remove, scratch, spread, written

__all__ = ["Forest", "LOWER", "Memo", "bounded_batches", "connected_components", "fresh", "gives_back", "mix64", "plain_words", "quiet_threads", "remove", "scratch", "sorted_groups", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


#: A batch on its way to a Python worker exists in the JVM and in the worker at once: so many bytes, not rows.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, the same for every operator; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def gives_back(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a task's function over batches; at its end the worker returns freed memory to the machine.

    Workers outlive their tasks and stand beside those of the next stage; free memory that they hold on to
    counts against the executor.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that no column of rows has, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


class Forest:
    """Union-find over 0..n-1 whose labels can be read as one array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.root[others], self.root[a]))
        if len(labels) > 1:
            self.root[np.isin(self.root, labels[1:])] = labels[0]

    def tree(self) -> np.ndarray:
        """(member, label) of the members that are not their own label: a spanning star of each part."""
        here = np.flatnonzero(self.root != np.arange(len(self.root)))
        return np.column_stack([here, self.root[here]])


#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split knows just these six)."""
    return utf8(text).translate(LOWER).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A cache of a pure function of short keys, emptied when full; long keys are never kept."""

    def __init__(self, f, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal keys of rows that come sorted by them, over batch borders."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new), len(pdf)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = pdf.iloc[lo:hi]
            if rest and lo == 0 and all(rest[-1][k].iloc[-1] == part[k].iloc[0] for k in keys):
                rest.append(part)
                continue
            if rest:
                yield rest[0] if len(rest) == 1 else pd.concat(rest)
            rest = [part]
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest)


def quiet_threads() -> None:
    """One thread per task: Spark deals the cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
