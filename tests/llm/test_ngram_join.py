import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from dossierspark.llm import ngram_join as J
from dossierspark.llm.common import plain_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, width, num, den):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 60), 1 << 60 if d is None else d)
    return sorted([(d, len(s), least[find(i)] if s and least[find(i)] < 1 << 60 else d) for i, ((d, _), s) in enumerate(zip(docs, sets))], key=str)


def family(rng, words, copies, edits):
    base = [f"v{rng.randrange(400)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        yield rng.choice([" ", "\n", "\t "]).join(own)


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "one", "ONE", "one two", "two one", "é\x85x y z", "a b c", "a b c", "A B  C d"]
    for words, copies, edits in ((5, 4, 1), (12, 8, 1), (30, 12, 2), (60, 40, 5), (150, 30, 10), (400, 10, 20), (3000, 4, 90)):
        texts += family(rng, words, copies, edits)
    line = " ".join(f"boiler{i}" for i in range(40))
    texts += [line + " " + t for t in family(rng, 80, 12, 80)]
    texts += ["w " * 5000, "w " * 7000]
    rng.shuffle(texts)
    return [(i * 3 % 997, t) for i, t in enumerate(texts)] + [(5, "one"), (5, "something else here now"), (None, "a b c"), (None, "lonely words stand here")]


@pytest.mark.parametrize("seed, width, num, den", [(1, 3, 90, 100), (2, 3, 90, 100), (3, 5, 80, 100)])
def test_against_brute_force(spark, seed, width, num, den):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n long, h string")
    got = sorted(map(tuple, J.jaccard_components(df, width, num, den).collect()), key=str)
    assert got == brute(docs, width, num, den)


def test_blocks_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 7)
    monkeypatch.setattr(J, "BLOCK_COUNTS", 11)
    docs = corpus(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == brute(docs, 3, 90, 100)


def test_repeated_and_null_ids_carry_their_own_texts(spark):
    rng = random.Random(9)
    one, two, three = (list(family(rng, 60, 3, 2)) for _ in range(3))
    docs = [(7, t) for t in (one[0], two[0], three[0], one[0])] + [(8, one[1]), (3, two[1]), (None, three[1]), (None, three[2]), (None, one[2])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == brute(docs, 3, 90, 100)


def test_one_of_each(spark):
    rng = random.Random(10)
    one, two = (list(family(rng, 200, 4, 2)) for _ in range(2))
    docs = [(1, one[0]), (1, one[0]), (5, one[1]), (5, "unrelated words that stay whole here"), (6, one[2]), (None, two[0]), (2, two[1]), (4, two[2])]
    docs += [(9, None), (9, None), (10, ""), (11, " \n"), (12, "x y"), (13, "X  y")]
    df = spark.createDataFrame([(d, t, i, "r", None) for i, (d, t) in enumerate(docs)], "doc_id long, text string, row int, number string, root string")
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    stay = [(1, one[0]), (5, "unrelated words that stay whole here"), (None, two[0]), (9, None), (9, None), (10, ""), (11, " \n"), (12, "x y")]
    assert got == sorted(stay, key=str)
    assert J.one_of_each(df.limit(0)).count() == 0


def test_task_joins_its_own_rows_and_buckets_the_rest():
    high = -(1 << 63) + 9  # the first bit is set: bucket 1
    here = J.joined_in_task(np.array([5, 5, 5, high, high, 7]), np.array([3, 1, 1, 1, 3, 8]), 1).to_pandas()
    assert here["bucket"].tolist() == [0, 1, 0] and here["names"].map(len).tolist() == [24, 12, 0]
    assert np.frombuffer(here["edges"][2], "<i8").tolist() == [3, 1]
    there = J.joined_in_task(np.array([7, high]), np.array([2, 4]), 1).to_pandas()
    rows = pd.concat([here, there]).sort_values("bucket", kind="stable").reset_index(drop=True)
    edges = pd.concat(J.joined_in_buckets(iter([rows[:2], rows[2:]])))
    assert set(edges.itertuples(index=False, name=None)) == {(3, 1), (8, 2), (4, 1)}


@pytest.mark.parametrize("bits", [1, 7, 23])
def test_packed_keys_join_what_share_one(bits):
    rng = np.random.default_rng(bits)
    keys = rng.integers(-(2**63), 2**63, 500)[rng.integers(0, 500, 3000)]
    nodes = rng.integers(0, 2**48, 3000)
    parts = [J.joined_in_task(keys[i::3], nodes[i::3], bits).to_pandas() for i in range(3)]
    rows = pd.concat(parts).sort_values("bucket", kind="stable").reset_index(drop=True)
    got, want = smallest_reached(pd.concat(J.joined_in_buckets(iter([rows]))).to_numpy().tolist()), smallest_reached(zip(nodes.tolist(), pd.Series(nodes).groupby(keys).transform("min").tolist()))
    assert {n: c for n, c in want.items() if c != n} == {n: c for n, c in got.items() if c != n}


def smallest_reached(edges):
    """The smallest node that each node reaches."""
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {x: up(x) for x in list(root)}


def test_no_documents(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    counts = rng.poisson(2, (700, J.COORDINATES)).astype(np.uint32)
    counts[350:] = np.maximum(0, counts[:350].astype(int) + rng.integers(-1, 2, (350, J.COORDINATES)) * (rng.random((350, J.COORDINATES)) < 0.2))
    sizes = counts.sum(axis=1).astype(np.int64)
    tree, wanted = J.CountTree(counts, sizes), np.ones(700, bool)
    for q in range(0, 700, 13):
        overlap = np.minimum(counts[q], counts).sum(axis=1)
        want = set(np.flatnonzero(100 * overlap >= 90 * (sizes[q] + sizes - overlap)))
        assert want == set(tree.search(q, int(sizes[q]), 90, 100, wanted)) and len(want) > 1


@pytest.mark.parametrize("num, den", [(90, 100), (80, 100)])
def test_linked_sets_share_a_key(num, den):
    bands, rng = J.Bands(num, den), np.random.default_rng(1)
    for n in [*range(1, 60), 150, 700, 3000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = a
            while True:  # as far apart as a link allows
                kept = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else b
                new = np.union1d(kept, rng.integers(0, 2**64, rng.integers(0, 2), dtype=np.uint64)).astype(np.uint64)
                both = len(np.intersect1d(a, new))
                if den * both < num * (len(a) + len(new) - both):
                    break
                b = new
            if len(a) != len(b) or (a != b).any():
                common = set(bands.of(len(a))) & set(bands.of(len(b)))
                assert any(set(J.group_keys(a, bands, w)) & set(J.group_keys(b, bands, w)) for w in common)


def test_counts_of_long_sets_tell_them_apart_and_fold():
    rng = np.random.default_rng(5)
    near = rng.integers(0, 2**64, 12_000, dtype=np.uint64)
    a, b, other = near[:11_000], near[500:], rng.integers(0, 2**64, 11_500, dtype=np.uint64)
    rows = J.of_one_width([J.count_vector(s, J.coordinates(len(s))).tobytes() for s in (a, b, other)])
    sizes = np.array([len(s) for s in (a, b, other)])
    tree = J.CountTree(rows, sizes)
    assert set(tree.search(0, len(a), 80, 100, np.ones(3, bool))) == {0, 1}
    short = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    mixed = J.of_one_width([J.count_vector(s, J.coordinates(len(s))).tobytes() for s in (short, a)])
    assert mixed.shape == (2, J.COORDINATES) and (mixed[1] == J.count_vector(a, J.COORDINATES)).all()


def test_long_sets_of_more_widths_than_one(spark):
    rng = random.Random(12)
    texts = [t for words, edits in ((2055, 20), (9000, 150)) for t in family(rng, words, 4, edits)]
    texts += [" ".join(t.split()[:-lost]) for t, lost in zip(texts, (20, 5, 60, 9, 200, 900, 30, 400))]
    texts += [" ".join(f"v{rng.randrange(400)}" for _ in range(n)) for n in (2040, 2060, 8900, 9000)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == brute(docs, 3, 90, 100)


def test_common_lines_do_not_chain_families(spark, monkeypatch):
    rng, sizes, write = random.Random(13), {}, J.written
    line = " ".join(f"boiler{i}" for i in range(100))
    texts = [f"{line} {' '.join(f'v{rng.randrange(10**9)}' for _ in range(300))}" for _ in range(150)]
    texts += [t + " one more" for t in texts[:20]] + list(family(rng, 300, 30, 20))
    docs = list(enumerate(texts))

    def counted(df, tag):
        out = write(df, tag)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(J, "SHOWN", 1, raising=False)
    monkeypatch.setattr(J, "written", counted)
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80, 100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, 5, 80, 100)
    assert 40 <= sizes["members"] <= 200


@pytest.mark.parametrize("num, den", [(90, 100), (80, 100)])
def test_linked_sets_share_a_key_whatever_is_common(num, den):
    bands, rng = J.Bands(num, den), np.random.default_rng(2)
    for n in [*range(4, 40, 3), 150, 700]:
        for share in (0.2, 0.7, 1.0):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = a.copy()
            while den * (len(b) - 1) >= num * len(a):
                b = np.delete(b, rng.integers(len(b)))
            flat, bounds = np.r_[a, b], np.array([0, len(a), len(a) + len(b)])
            common = (flat % np.uint64(1000)) < np.uint64(share * 1000)
            (of, windows), found = bands.windows(np.diff(bounds)), {}
            entry, keys = J.keys_of_sets(flat, bounds, bands, of, windows, common)
            for e, k in zip(entry.tolist(), keys.tolist()):
                found.setdefault((of[e], windows[e]), set()).add(k)
            assert len(a) == len(b) or any(found[0, w] & found.get((1, w), set()) for w in bands.of(len(a)))


def test_words_by_arrays_are_those_of_a_split():
    texts = [None, "", " \n", "One two", "oNE\x0b TWO\x0c", "é\x85x y", "a" * 9, "A" * 9 + " " + "b" * 70 + "\t" + "b" * 71, "x\x00 x", "x", "one", "日本 語", "abcdefgh abcdefghi abcdefghij" * 3]
    texts = texts[:5] + ["tail"] + texts[5:]
    h, bounds = J.word_hashes(pa.array([*texts, "left out"], pa.large_string()).slice(0, len(texts)))
    words = [w for t in texts for w in plain_words(t)]
    assert np.diff(bounds).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    later = J.word_hashes(pa.array(["skipped", *texts], pa.large_string()).slice(1))
    assert (later[0] == h).all() and (later[1] == bounds).all()
