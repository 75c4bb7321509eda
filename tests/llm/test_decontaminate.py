import hashlib
import random
import re

import numpy as np

from dossierspark.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = [(i, tuple(words(t)[j : j + 10])) for i, t in items for j in range(max(1, len(words(t)) - 9)) if words(t)]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, win in windows:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    found.add(i if i is None else str(i))
        sha = hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def make(seed, n_docs, n_items, short=True):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Ä😀", "x1"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25] if short else [10, 30]))) for i in range(n_items)] + [(50, None), (51, "..."), (None, "w1 w2"), (None, "w2 w2 w1")]
    docs = [(i, text(rng.randint(0, 60)) + " " + rng.choice(items[:n_items])[1] + " " + text(5)) for i in range(n_docs)]
    docs += [(900, None), (901, ""), (902, "  ..."), (0, docs[0][1]), (0, docs[0][1]), (None, items[0][1]), (903, items[1][1].upper() * 3), (904, "filler " * 30_000 + items[2][1])]
    return docs, items


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = D.contamination(d, b)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    clean = D.clean_documents(d, b).collect()
    assert sorted((r["doc_id"] for r in clean), key=str) == sorted((r[0] for r in brute(docs, items) if not r[5]), key=str)


def test_against_brute_force(spark):
    for seed in range(3):
        check(spark, *make(seed, 30, 8, short=seed != 1))


def test_phrases_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_BLOCK", 3)
    check(spark, *make(5, 20, 9))


def test_empty_tables(spark):
    docs, items = make(1, 3, 3)
    check(spark, docs, [(1, None)])
    d = spark.createDataFrame([], "doc_id long, text string")
    assert D.contamination(d, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_index_locates_every_occurrence():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.r_[rng.integers(1, 5, n), 0] for n in (1, 40, 3, 200, 40)])
    index = D.FMIndex(text, 4)
    for size in (1, 2, 4):
        for start in range(0, len(text) - size, 7):
            p = text[start : start + size]
            if (p == 0).any():
                continue
            lo, hi = index.search(p[::-1][None, :])
            at = sorted(index.locate(np.arange(lo[0], hi[0])))
            assert at == [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]


def test_cut_spans():
    text = "One two, THREE four; five"
    assert D.cut_spans(text, [[1, 3]]) == "One \n\n four; five"
    assert D.cut_spans(text, []) == text and D.cut_spans(None, [[0, 1]]) is None
