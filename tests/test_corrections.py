import datetime as dt
import os

from pyspark.sql import functions as F

from dossierspark.operators import corrections as C
from dossierspark.operators.lineage import elect

ITEMS = "item_id long, document_id long, cluster_id long, promoted boolean, effective_date date, created_at timestamp, text string"
DAY, NOW = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def item(i, document, cluster, day=0):
    return (i, document, cluster, i % 5 == 0, DAY + dt.timedelta(days=day or i % 7), NOW, f"t{i}")


def library(spark, path):
    elections = {(r["item_id"], r["cluster_id"], r["canonical_id"]) for r in spark.read.parquet(f"{path}/elections").collect()}
    items = {(r["item_id"], r["document_id"], r["cluster_id"], r["text"]) for r in spark.read.parquet(f"{path}/items").collect()}
    return elections, items


def built(spark, rows):
    d = spark.createDataFrame(rows, ITEMS)
    return {(r["item_id"], r["cluster_id"], r["canonical_id"]) for r in elect(d).collect()}, {(r[0], r[1], r[2], r[6]) for r in rows}


def test_a_rerun_equals_a_full_rebuild_and_touches_its_parts_alone(spark, tmp_path):
    rows = [item(i, i % 20, i // 3) for i in range(200)] + [item(900, 77, 500)]
    path = f"{tmp_path}/library"
    C.write_library(spark.createDataFrame(rows, ITEMS), path, parts=16)
    assert library(spark, path) == built(spark, rows)
    before = files(path)

    fresh = [item(3, 3, 1), item(1000, 3, 600, 5), item(1001, 3, 2, 6), item(5, 4, 1)]  # the last is of a document that does not run
    wanted = spark.createDataFrame([(3,), (3,), (77,), (None,), (12345,)], "document_id long")
    done = C.rerun(spark, path, wanted, spark.createDataFrame(fresh, ITEMS), parts=16)
    after = [r for r in rows if r[1] not in (3, 77)] + fresh[:3]
    assert library(spark, path) == built(spark, after)
    assert {r["source_id"] for r in done.removed.collect()} == {r[0] for r in rows if r[1] in (3, 77)} - {3}
    was, now = ({c: e for _, c, e in built(spark, x)[0]} for x in (rows, after))
    assert {tuple(r) for r in done.reelected.collect()} == {(c, was.get(c), now.get(c)) for c in {*was, *now} if was.get(c) != now.get(c)}
    assert (500, 900, None) in {tuple(r) for r in done.reelected.collect()}

    # a part that holds neither a document of the rerun nor a touched cluster keeps its files
    parts = lambda keys: {r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(C._part("k", 16)).collect()}
    touched = {f"items/part={p}/" for p in parts([3, 77, 12345])} | {f"elections/part={p}/" for p in parts({r[2] for r in rows if r[1] in (3, 77)} | {1, 600, 2})}
    kept = {f for f in before if not any(t in f for t in touched)}
    assert kept and kept <= files(path)

    again = C.rerun(spark, path, wanted, spark.createDataFrame(fresh, ITEMS), parts=16)
    assert library(spark, path) == built(spark, after) and again.removed.count() == 0 and again.reelected.count() == 0


def test_a_library_may_lose_everything(spark, tmp_path):
    path = f"{tmp_path}/library"
    C.write_library(spark.createDataFrame([item(1, 1, 1), item(2, 2, 1)], ITEMS), path, parts=4)
    C.rerun(spark, path, spark.createDataFrame([(1,)], "document_id long"), spark.createDataFrame([], ITEMS), parts=4)
    assert library(spark, path) == built(spark, [item(2, 2, 1)])


def test_patches(spark):
    documents = spark.createDataFrame(
        [(i, "past_submission", None, DAY, "text", "B", None, False) for i in range(1, 9)] + [(9, "reference", "k", DAY, "text", None, None, None)],
        "document_id int, doc_type string, doc_kind string, effective_date date, effective_date_source string, buyer string, submission_date date, confirmed boolean",
    )
    patches = spark.createDataFrame([
        (1, 1, {"buyer": None}), (2, 1, {"buyer": "old"}), (2, 2, {"submission_date": "2024-03-04"}), (3, 1, {"effective_date": ""}), (4, 1, {"effective_date": "2024-01-01"}),
        (5, 1, {"effective_date": "2025-01-01"}), (6, 1, {"submission_date": "soon"}), (7, 1, {"doc_type": "tender_document"}), (8, 1, {"doc_type": "reference", "doc_kind": "k", "effective_date": "2025-01-01"}),
        (9, 1, {"doc_kind": None}), (99, 1, {"buyer": "none"}),
    ], "document_id int, at int, changes map<string,string>")
    out = C.patched(documents, patches, ["k"])
    got = {r["document_id"]: r for r in out.collect()}
    assert {i: r["problem"] for i, r in got.items()} == {1: None, 2: None, 3: "effective_date cleared", 4: None, 5: None, 6: "submission_date", 7: "doc_type", 8: None, 9: "reference without a kind"}
    assert got[1]["buyer"] is None and got[2]["buyer"] == "B" and got[2]["submission_date"] == dt.date(2024, 3, 4) and got[6]["submission_date"] is None
    assert [i for i, r in got.items() if r["date_moved"]] == [5, 8] and [i for i, r in got.items() if r["runs_again"]] == [8]
    assert got[5]["effective_date_source"] == "user" and got[4]["effective_date_source"] == "text" and got[8]["doc_kind"] == "k" and got[9]["doc_kind"] == "k"
    assert sorted(i for i, r in got.items() if r["confirmed"]) == [1, 2, 4, 5, 8]

    later = dt.date(2025, 1, 1)
    facts = spark.createDataFrame([(1, 5, DAY), (2, 5, later), (3, 5, None), (4, 8, DAY), (5, 1, DAY), (6, 50, DAY)], "fact_id int, document_id int, effective_date date")
    assert {r["fact_id"]: r["effective_date"] for r in C.facts_moved(facts, out).collect()} == {1: later, 2: later, 3: None, 4: DAY, 5: DAY, 6: DAY}
    assert C.patched(documents, patches.limit(0), ["k"]).where(F.col("confirmed") | F.col("problem").isNotNull()).count() == 0
