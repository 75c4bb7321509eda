import hashlib
import random
import re

import numpy as np
import pytest

from dossierspark.llm import substrings as S

W = S.WINDOW


def brute(rows):
    words = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for _, t in rows]
    key = [-(2**63) if d is None else d for d, _ in rows]
    least = {}
    for w, k in zip(words, key):
        for i in range(len(w) - W + 1):
            g = tuple(w[i : i + W])
            least[g] = min(k, least.get(g, k))
    out = []
    for (d, _), w, k in zip(rows, words, key):
        gone = {p for i in range(len(w) - W + 1) if least[tuple(w[i : i + W])] < k for p in range(i, i + W)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 5, b"") for r in rows], "doc_id long, text string, kept_sha256 string, n_words int, blob binary")
    return sorted((tuple(r) for r in S.substring_dedup(df).collect()), key=str)


def corpus(seed, n=120, vocabulary=300):
    rng = random.Random(seed)
    some = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    shared = [some(rng.randrange(40, 130)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = some(rng.randrange(150))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            lo = rng.randrange(20)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[lo:]
        rows.append((rng.randrange(10 * n), " ".join(w)))
    return rows + [(rng.randrange(10 * n), t) for _, t in rng.sample(rows, 20)]


@pytest.mark.parametrize("group", [8192, 8])
def test_equals_brute_force(spark, monkeypatch, group):
    """With parts of 8 suffixes most shared prefixes are dealt out."""
    monkeypatch.setattr(S, "GROUP", group)
    rows = corpus(1) if group > 8 else corpus(2, 60, 3)
    out = got(spark, rows)
    assert out == brute(rows) and sum(r[2] for r in out) > 500


def test_nulls_ties_repeats_and_ends(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(None, p), (None, p + " more"), (3, None), (4, ""), (5, " \t\n "), (6, p), (6, p), (6, "é " + p + " ü"), (7, "x\x85 " + p.replace(" ", "\n\t")), (8, " ".join(p.split()[:49])), (9, " ".join(p.split()[5:55])), (10, "a " * 500), (11, "a " * 500)]
    assert got(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(4)
    long = [f"v{rng.randrange(900)}" for _ in range(60_000)]
    rows = [(1, " ".join(long[30_000:30_080])), (2, " ".join(long)), (3, " ".join(long[100:30_050]))]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_each_window_has_the_anchor_of_equal_windows():
    rng = random.Random(9)
    memo = S.Memo(S.xxhash.xxh3_64_intdigest)
    w = [str(rng.randrange(2)).encode() for _ in range(700)]
    gram, place, first, last = S.anchors(S.word_hashes(w, memo))
    assert first[0] == 0 and last[-1] == len(w) - W and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + S.PLACES - 1)).all()
    where = np.searchsorted(last, np.arange(len(w) - W + 1))
    seen = {}
    for i, a in enumerate(where):
        found = (gram[a], place[a] - i)
        assert seen.setdefault(tuple(w[i : i + W]), found) == found
