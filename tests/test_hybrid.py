"""The search over lexical, vector and topic lists."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from dossierspark.operators import retrieval as R
from dossierspark.plans.retrieval_queries import coverage_triage, hybrid_retrieval


def test_lists(spark):
    texts = spark.createDataFrame([(1, None, "alpha"), (2, None, "other words"), (3, None, "more")], "item_id long, question string, answer string")
    items = spark.createDataFrame([(1, [0.0, 1.0], ["a"]), (2, [1.0, 0.0], ["a", "b"]), (3, [1.0, 0.1], None)], "item_id long, vector array<double>, topics array<string>")
    queries = spark.createDataFrame([(5, "alpha", [1.0, 0.0], ["b", "a"]), (6, "zeta", [1.0, 0.0], ["c"])], "query_id long, text string, vector array<double>, topics array<string>")
    lists = {n: sorted((r["query_id"], r["rank"], r["item_id"]) for r in d.collect()) for n, d in R.retrieval_lists(texts, items, queries).items()}
    assert lists["lexical"] == [(5, 1, 1)]
    assert lists["vector"] == [(q, n, i) for q in (5, 6) for n, i in ((1, 2), (2, 3), (3, 1))]
    assert lists["topic"] == [(5, 1, 2), (5, 2, 1)]


def test_found_without_a_common_word_and_floor(spark, tmp_path):
    docs = [(1, "alpha beta gamma"), (2, "Alpha  beta gamma"), (3, "unlike words only"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "zzz qqq")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query_id"], r["item_id"]): r for r in hybrid_retrieval(spark, str(tmp_path)).collect()}
    assert (1, 1) in got and (1, 2) not in got  # copies collapsed
    assert got[1, 1]["vector_score"] == 1.0 and got[1, 1]["rank"] == 1
    assert (2, 3) in got and got[2, 3]["lexical_rank"] is None
    labels = {r["query_id"]: (r["coverage"], r["label_source"]) for r in coverage_triage(spark, str(tmp_path)).collect()}
    assert labels == {1: ("covered", "judge"), 2: ("new", "floor")}


def test_lexical_scores_leave_the_best_of_each_task(spark):
    texts = {i: " ".join(["alpha"] * (i % 7) + ["beta,É-gamma"] * (i % 3) + ["x9"] * (i % 11)) for i in range(900)}
    texts |= {900: None, 901: "", 902: "ÀÉ  ", 903: "alpha", 904: "ALPHA"}
    items = spark.createDataFrame([(i, "gamma" if i % 5 == 0 else None, t) for i, t in texts.items()], "item_id long, question string, answer string").repartition(3)
    asked = {1: "alpha Beta or", 2: "gamma x9 x9", 3: "unknown", 4: "describe"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    want = {}
    for i, t in texts.items():
        words = [(w, 10) for w in (["gamma"] if i % 5 == 0 else [])] + [(w, 4) for w in re.findall("[0-9a-z]+", (t or "").lower())]
        for q, terms in {1: {"alpha", "beta"}, 2: {"gamma", "x9"}}.items():
            hit = Counter()
            for w, n in words:
                if w in terms:
                    hit[w] += n
            if hit:
                want[q, i] = (len(hit), sum(hit.values()) / 10.0 / math.log(len(words) + 1.0))
    every = R.lexical_scores(items, queries, stem=False).collect()
    assert {(r["query_id"], r["item_id"]): (r["n_terms"], r["score"]) for r in every} == want and len(every) == len(want)
    some = R.lexical_scores(items, queries, stem=False, most=5, by=("score", "n_terms")).withColumn("task", F.spark_partition_id()).collect()
    assert max(Counter((r["task"], r["query_id"]) for r in some).values()) <= 10
    left = {(r["query_id"], r["item_id"]) for r in some}
    for q in (1, 2):
        rows = [(i, n, s) for (k, i), (n, s) in want.items() if k == q]
        for key in (lambda r: (-r[2], r[0]), lambda r: (-r[1], r[0])):
            assert {(q, r[0]) for r in sorted(rows, key=key)[:5]} <= left


def test_vector_lists_leave_the_best_of_each_task(spark):
    vector = F.array(F.sin(F.col("id")), F.cos(F.col("id") * 3), F.lit(0.5))
    items = spark.range(0, 9000, 1, 1).select(F.col("id").alias("item_id"), vector.alias("vector"), (F.col("id") % 2).cast("string").alias("topic"))
    queries = items.where("item_id % 3000 = 0").withColumnRenamed("item_id", "query_id")
    for topic in (False, True):
        sent = R._best_of_batches(items, queries.toArrow(), 4, topic).collect()
        assert len(sent) == 3 * 4
        x = [(math.sin(i), math.cos(i * 3), 0.5) for i in range(9000)]
        size = [math.sqrt(sum(a * a for a in v)) for v in x]
        for q in (0, 3000, 6000):
            score = {i: round(sum(a * b for a, b in zip(x[q], x[i])) / size[q] / size[i], 9) for i in range(9000) if not topic or (i - q) % 2 == 0}
            assert {r["item_id"] for r in sent if r["query_id"] == q} == set(sorted(score, key=lambda i: (-score[i], i))[:4])
