import hashlib
import random
import zlib

from dossierspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, grp string, idx string, node string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    doc, text, lang, source, n = r
    values = (doc, source, lang, None if n is None else n + more, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(root, siblings by leaf): plain levels, a run at a time."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf_no, node in enumerate(at):
            run = level[node - node % 2 : node - node % 2 + 2]
            paths[leaf_no].append((node % 2, run[1 - node % 2] if len(run) == 2 else None))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [n // 2 for n in at]
    return level[0] if level else None, paths


def fold(node, path):
    for right, s in path:
        node = h(node) if s is None else h(s, node) if right else h(node, s)
    return node


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    subs = {}
    for lang in langs:
        here = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[lang] = (here, *climb([leaf(r) for r in here]))
    root, tops = climb([subs[v][1] for v in langs])
    out = []
    for lang, top in zip(langs, tops):
        here, sub, paths = subs[lang]
        for r, path in zip(here, paths):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            again = fold(fold(leaf(r, int(bad)), path), top)
            proof = h(*[s for _, s in path + top if s])
            out.append((r[0], leaf(r), sub, root, proof, again, again == root))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.manifest(df).select(*names).collect()), key=str)


def test_matches_plain_levels(spark):
    rng = random.Random(3)
    rows = [(i, f"té{i % 50} " * (i % 5), rng.choice(["en", "en", "en", "", "ß"]), "s", i) for i in rng.sample(range(2000), 900)]
    rows += [(5000 + i, "x", "one" if i == 0 else "two", None, None) for i in range(3)]
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "", None, "a", 0), (7, "w" * 300_000, None, "a", 1)]
    rows += [(3, "same", "en", "a", 4)] * 5 + [(3, "unlike", "en", "a", 6), (14, "14", "en", "a", None), (-1, "", "en", "", 2**31 - 1)]
    out = got(spark, rows)
    assert out == brute(rows)
    assert sum(not r[6] for r in out) == sum(r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in rows)


def test_sizes_about_a_block(spark):
    for n in (1, 2, 255, 257, 513):
        rows = [(i, str(i), "en", "s", 1) for i in range(n)]
        assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
