"""Corrections and reruns over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corrections as C
from ..operators.components import scratch
from ..settings import SUPERSEDABLE_DOC_KINDS
from .registry import query, table


def _library(spark, sf):
    """Documents as items of 31 documents in 83 clusters."""
    k, d = F.col("doc_id"), F.col("n_chars") % 5
    return table(spark, sf, "documents").select(
        k.alias("item_id"), (k % 31).alias("document_id"), (k % 83).alias("cluster_id"), (F.col("lang") == "en").alias("promoted"),
        F.when(d > 0, F.date_add(F.lit("2020-01-01").cast("date"), d.cast("int"))).alias("effective_date"), F.timestamp_seconds("doc_id").alias("created_at"),
    )


@query(
    """WITH all_items AS (
  SELECT doc_id AS item_id, CASE WHEN again THEN (doc_id + 1) % 83 ELSE doc_id % 83 END AS cluster_id, lang = 'en' AND NOT again AS promoted, n_chars % 5 AS d
  FROM (SELECT *, (doc_id % 31) % 7 = 3 AS again FROM documents) WHERE NOT again OR doc_id % 2 = 0)
SELECT item_id, cluster_id, first_value(item_id) OVER (PARTITION BY cluster_id ORDER BY coalesce(promoted, false) DESC, CASE WHEN d = 0 THEN NULL ELSE d END DESC NULLS LAST, item_id) AS canonical_id
FROM all_items"""
)
def rerun_elections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document runs again, loses its odd items and moves the others to other clusters; the
    elections of the stored library then are those of a library built anew."""
    path, items = scratch(spark, "library"), _library(spark, sf_dir)
    C.write_library(items, path)
    again = items.where("document_id % 7 = 3")
    fresh = again.where("item_id % 2 = 0").withColumn("cluster_id", (F.col("item_id") + 1) % 83).withColumn("promoted", F.lit(False))
    C.rerun(spark, path, again.select("document_id"), fresh)
    return spark.read.parquet(f"{path}/elections").select("item_id", "cluster_id", "canonical_id")


KIND = SUPERSEDABLE_DOC_KINDS[0]


@query(
    f"""WITH d AS (SELECT doc_id AS document_id, doc_id % 9 AS m, doc_id % 2 = 0 AS ref, CASE WHEN doc_id % 4 = 0 THEN '{KIND}' END AS kind,
  CASE WHEN doc_id % 5 = 0 THEN DATE '2024-05-01' ELSE DATE '2023-01-01' + CAST(doc_id % 300 AS INTEGER) END AS day FROM documents),
p AS (SELECT *, CASE WHEN m = 4 THEN 'effective_date' WHEN m = 5 THEN 'unknown field' WHEN m = 6 THEN 'doc_kind'
  WHEN m IN (0, 3) AND ref AND kind IS NULL THEN 'reference without a kind' WHEN m = 7 AND (NOT ref OR kind IS NULL) THEN 'reference without a kind' END AS problem FROM d),
a AS (SELECT *, m <> 8 AND problem IS NULL AS act FROM p),
t AS (SELECT *, CASE WHEN act AND m IN (1, 7) THEN 'reference' WHEN act AND m = 2 THEN 'past_submission' WHEN ref THEN 'reference' ELSE 'past_submission' END AS doc_type FROM a)
SELECT document_id, doc_type, CASE WHEN NOT act THEN kind WHEN m = 1 THEN '{KIND}' WHEN doc_type = 'reference' THEN kind END AS doc_kind,
  CASE WHEN act AND m = 0 THEN 'A Trust' END AS buyer, CAST(CASE WHEN act AND m = 3 THEN DATE '2024-05-01' ELSE day END AS VARCHAR) AS effective_date, problem,
  act AND m = 3 AND day <> DATE '2024-05-01' AS date_moved, act AND (doc_type = 'reference') <> ref AS runs_again, act AS confirmed FROM t"""
)
def patched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of every kind, good and refused, over all documents."""
    k = F.col("doc_id")
    date = F.when(k % 5 == 0, F.lit("2024-05-01").cast("date")).otherwise(F.date_add(F.lit("2023-01-01").cast("date"), (k % 300).cast("int")))
    none = F.lit(None).cast("string")
    documents = table(spark, sf_dir, "documents").select(
        k.alias("document_id"), F.when(k % 2 == 0, "reference").otherwise("past_submission").alias("doc_type"), F.when(k % 4 == 0, KIND).alias("doc_kind"), date.alias("effective_date"),
        F.lit("text").alias("effective_date_source"), none.alias("buyer"), none.cast("date").alias("submission_date"), F.lit(False).alias("confirmed"),
    )
    each = [{"buyer": " A Trust "}, {"doc_type": "reference", "doc_kind": KIND}, {"doc_type": "past_submission"}, {"effective_date": "2024-05-01"}, {"effective_date": "2024-02-31"}, {"colour": "x"}, {"doc_kind": "nonsense"}, {"doc_type": "reference"}]
    change = F.lit(None).cast("map<string,string>")
    for n, fields in enumerate(each):
        change = F.when(k % 9 == n, F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])).otherwise(change)
    patches = table(spark, sf_dir, "documents").where(k % 9 < 8).select(k.alias("document_id"), F.lit(1).alias("at"), change.alias("changes"))
    rows = C.patched(documents, patches, SUPERSEDABLE_DOC_KINDS)
    return rows.select("document_id", "doc_type", "doc_kind", "buyer", F.col("effective_date").cast("string").alias("effective_date"), "problem", "date_moved", "runs_again", "confirmed")
