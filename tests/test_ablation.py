import math
import random

import numpy as np
from pyspark.sql import functions as F

from dossierspark.functions.spans import hash_embedding
from dossierspark.operators import ablation as A


def test_configurations():
    rows = A.configurations()
    assert len({r["configuration"] for r in rows}) == 8
    assert rows[0]["configuration"] == "topic_list=on,vector_list=max,llm_rerank=off" and [r["configuration"] for r in rows[1:]] == sorted(r["configuration"] for r in rows[1:])


def plain(items, queries, order, lexical, c, most, top, pool):
    """One configuration, a query at a time."""
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    out = {}
    for q, vector, topic in queries:
        score = {}
        for i, a, b, t, _, ok, gone in items:
            if ok and not gone:
                score[i] = round(max([cos(vector, x) for x in ((a, b) if c["vector_list"] == "max" else (a,)) if x] or [-1]), 9)
        by_score = sorted((i for i in score if score[i] > -1), key=lambda i: (-score[i], i))
        topics = {r[0]: r[3] for r in items}
        lists = [[i for q2, i in lexical if q2 == q and i in score], by_score[:most], [i for i in by_score if topics[i] == topic][:most] if c["topic_list"] == "on" else []]
        fused = {i: round(sum(1 / (60 + x.index(i) + 1) for x in lists if i in x), 9) for i in {i for x in lists for i in x}}
        ordered = sorted(fused, key=lambda i: (-fused[i], -score[i], i))
        clusters, seen, kept = {r[0]: r[4] for r in items}, set(), []
        for i in ordered:
            if clusters[i] not in seen:
                seen.add(clusters[i])
                kept.append(i)
        kept = kept[: max(top, pool)]
        if c["llm_rerank"] == "on":
            place = {}
            for q2, i, p in order:
                if q2 == q:
                    place[i] = min(p, place.get(i, p))
            kept = sorted(kept, key=lambda i: (place.get(i, math.inf), kept.index(i)))
        out[q] = kept[:top]
    return out


def test_every_configuration_equals_a_plain_search(spark):
    rng = random.Random(3)
    vec = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(4)]
    items = [(i, vec() if i % 4 else None, vec() if i % 3 else None, f"t{i % 3}", i // 2, i % 11 != 0, i % 13 == 0) for i in range(90)]
    items += [(200, items[1][1], items[1][2], "t1", 77, True, False), (201, items[1][1], items[1][2], "t1", 78, True, False)]  # ties
    queries = [(1, vec(), "t1"), (2, vec(), "t9"), (3, vec(), "t0")]
    order = [(q, rng.randrange(120), rng.randrange(15)) for q in (1, 2, 3) for _ in range(60)]
    lexical = [(1, i) for i in (5, 11, 24, 200, 12)] + [(2, 36)]  # 11 and 0 may not be ranked, 12 and 24 lack one or both vectors
    d = lambda rows, s: spark.createDataFrame(rows, s)
    got = A.ablations(
        d(items, "item_id long, answer_vector array<double>, question_vector array<double>, topic string, cluster_id long, text_verified boolean, excluded boolean"),
        d(queries, "query_id long, vector array<double>, topic string"), d([(q, i, p) for q, i, p in dict.fromkeys(order)], "query_id long, item_id long, position int"),
        d([(q, i, n + 1, 1.0) for q in (1, 2) for n, i in enumerate(i for q2, i in lexical if q2 == q and i not in (11,))], "query_id long, item_id long, rank int, score double"),
        most=10, top=6, pool=9,
    )
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault(r["configuration"], {}).setdefault(r["query_id"], []).append(r["item_id"])
    want = {c["configuration"]: plain(items, queries, order, lexical, c, 10, 6, 9) for c in A.configurations()}
    assert found == want
    assert len({str(v) for v in want.values()}) > 4  # the switches matter


def test_query_vectors(spark):
    rows = [(1, "Q", [3.0, 4.0], None), (2, "Q", [3.0, 4.0], " Q\n"), (3, "Q", [3.0, 4.0], "other"), (4, "Q", None, None), (5, None, None, None), (6, "Q", [1.0, 0.0], "  ")]
    d = spark.createDataFrame(rows, "query_id int, question string, embedding array<float>, text string")
    seen = {r["query_id"]: (r["stored"], r["vector"]) for r in A.query_vectors(d, lambda c: hash_embedding(c, 8)).collect()}
    made = {t: v for t, v in spark.createDataFrame([("other",), ("Q",)], "t string").select("t", hash_embedding("t", 8)).collect()}
    assert seen == {1: (True, [3.0, 4.0]), 2: (True, [3.0, 4.0]), 3: (False, made["other"]), 4: (False, made["Q"]), 5: (False, None), 6: (False, None)}


def test_verbatim_candidates(spark):
    kept = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1), (3, 12, 1), (4, 13, 1), (5, 10, 1)], "query_id int, item_id int, rank int")
    items = spark.createDataFrame([(10, "qa_pair", [1.0, 0.0]), (11, "text", [1.0, 0.0]), (12, "qa_pair", None), (13, "qa_pair", [0.0, 0.0])], "item_id int, item_type string, question_vector array<double>")
    queries = spark.createDataFrame([(q, [2.0, 0.1] if q < 5 else [1.0, 0.5]) for q in range(1, 6)], "query_id int, vector array<double>")
    rows = A.verbatim_candidates(kept, items, queries).select("query_id", "item_id", F.col("similarity") > 0.99).collect()
    assert [tuple(r) for r in rows] == [(1, 10, True)]
