import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from dossierspark.llm import periodic


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute_runs(w):
    """Every stretch, by definition."""
    n, out = len(w), []
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = smallest_period(w[s:e])
            if e - s < max(6, 4 * q):
                continue
            if s and w[s - 1] == w[s - 1 + q] or e < n and w[e] == w[e - q]:
                continue
            out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def lag_runs(w):
    """Maximal stretches lag by lag, for texts too long for the definition."""
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def ids(w):
    return periodic.word_ids([str(x).encode() for x in w])


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(34))]
    if seed % 3 == 0:
        w = w[:7] + w[:3] * rng.randrange(6) + w[7:]
    assert periodic.runs_of(ids(w)) == brute_runs(w) == lag_runs(w)


@pytest.mark.parametrize("seed", range(12))
def test_long_texts_with_long_periods(seed):
    rng = random.Random(seed)
    w = [rng.randrange(400) for _ in range(300)]
    for _ in range(4):
        p = rng.choice([1, 5, 63, 64, 65, 90, 200])
        part = [rng.randrange(400) for _ in range(p)]
        w += (part * 6)[: rng.randrange(3 * p, 6 * p)] + [rng.randrange(400) for _ in range(rng.randrange(70))]
    assert periodic.runs_of(ids(w)) == lag_runs(w)


def brute(doc_id, text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = lag_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(160)))) for i in range(150)]
    rows += [(None, None), (None, "a a a a a a a"), (1, ""), (2, " \t\n"), (3, "x " * 9), (3, "x " * 9), (4, "a a a a " * 8), (5, "é ü " * 30 + "z")]
    rows += [(20_000, "word " * 30_000), (20_001, " ".join(str(i % 700) for i in range(6000)))]
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, n_runs int, start string")
    got = [tuple(r)[:8] for r in periodic.periodic_runs(df).collect()]
    small = [brute(*r) for r in rows if r[0] is None or r[0] < 20_000]
    assert sorted((g for g in got if g[0] is None or g[0] < 20_000), key=str) == sorted(small, key=str)
    long = {g[0]: g for g in got}
    assert long[20_000][1:5] == (1, 0, 30_000, 1) and long[20_001][2:5] == (0, 6000, 700)


def test_shift_doubling_leaves_the_heads_of_stretches():
    bits = int("0111101110111111", 2)
    assert np.flatnonzero([periodic.stretches(bits, 4) >> i & 1 for i in range(16)]).tolist() == [0, 1, 2, 11]


def test_empty(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
