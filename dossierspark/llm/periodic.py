"""Periodic runs of words, found by bit-parallel lags, and texts with the repeats of runs taken out.

The words of a text get ids in order of first occurrence, and the ids' binary digits become bit planes: Python
integers with a bit for each word. For a lag q the planes are XORed with themselves shifted by q and ORed to
mismatches; the complement has a one wherever words q apart are equal. A run of period q and length L is a stretch
of L - q ones, and shift-doubling ANDs leave ones only where a stretch of ``max(LEAST, TIMES * q) - q`` begins. Random
words lose all of them after one or two planes, so most lags end there. Stretches with equal ends are one run, of
the smallest lag.

Long texts: before a lag's planes are compared, every GRID-th part of a possible run is probed (a stretch of at
least 3q ones holds a whole block of 3q/2 places of any such grid); the work of the probes is n log n for n words.

Nulls: a null text has no words; a null doc_id has no remainder, so its words stay as they are. Empty and blank
texts have no runs and keep no words. A very long text is one row, searched as a whole. Ties: of runs with
equal length/period the smallest start, then period. Repeated rows give repeated results; an empty table gives none;
other columns of documents, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

#: A run is at least so long, in words and in periods.
LEAST, TIMES = 6, 4
#: Neighbouring places of a grid point that are compared before a lag's planes are.
PROBES = 6

REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """words, of every tenth document with a periodic end."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, part = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + part]


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane b has bit i where word i's id has digit b."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(top)]


def stretches(bits: int, least: int) -> int:
    """Ones where at least `least` ones in a row begin, by shift-doubling."""
    have = 1
    while have < least and bits:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    return bits


def probed_lags(ids: np.ndarray, first: int) -> Iterator[int]:
    """The lags from `first` on at which some block of a possible run begins with equal words."""
    n = len(ids)
    for q in range(first, n // TIMES + 1):
        at = np.arange(0, n - q, 3 * q // 2)
        for t in range(PROBES):
            at = at[at < n - q - t]
            at = at[ids[at + t] == ids[at + t + q]]
            if not len(at):
                break
        else:
            yield q


#: Lags from here on are probed first; a block of their grid has PROBES places.
GRID = 64


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    planes = bit_planes(ids)
    found: dict[tuple[int, int], int] = {}
    top = n // TIMES

    def lags() -> Iterator[int]:
        yield from range(1, min(GRID - 1, top) + 1)
        yield from probed_lags(ids, GRID)

    for q in lags():
        least = max(LEAST, TIMES * q) - q
        if n - q < least:
            break
        equal = (1 << (n - q)) - 1
        begins = stretches(equal, least)
        for plane in planes:
            equal &= ~(plane ^ (plane >> q))
            begins = stretches(equal, least)
            if not begins:
                break
        while begins:
            start = (begins & -begins).bit_length() - 1
            after = equal >> start
            ones = (~after & (after + 1)).bit_length() - 1
            found.setdefault((start, start + ones + q), q)
            begins = begins >> (start + ones) << (start + ones)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length/period, exactly; the first of equals."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")])
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            words = planted(utf8(text.as_py()).split(), doc_id)
            runs = runs_of(word_ids(words))
            best = strongest(runs)
            keep = kept_places(len(words), runs)
            shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            kept = [words[i] for i in np.flatnonzero(keep)]
            listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
            out.append((doc_id, len(runs), *shown, _sha(listed), _sha(b" ".join(kept)), len(words), len(words) - len(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A report of each document's runs, and the hash of its words without the repeats; no shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_reports, REPORT)
