"""Corrections of documents, and reruns that touch only what a document had a part in.

A library of items lies in two tables of one folder: the items, parted by their document, and the elections, parted by
cluster. A rerun reads and writes the parts of its documents and of the clusters that lose or gain a member; all
other parts keep their files. What is written is staged as a table first, elections before items, so a rerun that was
stopped may be started again with the same rows; clusters it had elected by then are not told as changed again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .components import remove, written
from .lineage import elect, moved_date

#: Parts of each table. More parts, less to rewrite for one document; a part should be some hundred MB.
PARTS = 64

# Fields that a correction may set, and types of document.
FIELDS = ["doc_type", "doc_kind", "effective_date", "buyer", "submission_date"]
DOC_TYPES = ["past_submission", "reference"]
DAY = r"\A\d{4}-\d{2}-\d{2}\z"


@dataclass
class Rerun:
    """removed: source_type, source_id, reason, for invalidation. reelected: cluster_id, previous, canonical_id (null: the
    cluster has no member left) where the two differ."""

    removed: DataFrame
    reelected: DataFrame


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_library(items: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write the items and the election of every cluster.

    items: item_id, document_id, cluster_id, promoted, effective_date, created_at and any others.
    """
    chosen = elect(items.select("item_id", "document_id", "cluster_id", "promoted", "effective_date", "created_at"))
    for rows, name, key in ((items, "items", "document_id"), (chosen, "elections", "cluster_id")):
        rows.withColumn("part", _part(key, parts)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/{name}")


def _replace(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Put rows (with part) in the place of the touched parts; a part without rows goes. A large part is written by several tasks."""
    spark = rows.sparkSession
    staged = written(rows, "staged")
    left = {r[0] for r in staged.select("part").distinct().collect()}
    staged.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for part in touched:
        if part not in left:
            remove(spark, f"{path}/part={part}")


def _touched(keys: DataFrame, parts: int) -> list[int]:
    """The parts of some keys: at most `parts` numbers."""
    return sorted(r[0] for r in keys.select(_part(keys.columns[0], parts)).distinct().collect())


def rerun(spark: SparkSession, path: str, documents: DataFrame, fresh: DataFrame, parts: int = PARTS) -> Rerun:
    """Put the fresh items of some documents in the place of those they had, and elect again in the clusters these touch.

    documents: document_id, those that run again; fresh: their new items with the library's columns. A document
    without fresh items loses all; fresh items of other documents are not taken. A document that the library does not
    have yet only gains. Repeated or null document ids count once or not at all.
    """
    ids = written(documents.select("document_id").where("document_id is not null").distinct(), "ids")
    fresh = written(fresh.join(ids, "document_id", "left_semi"), "fresh")
    parts_of_items = _touched(ids, parts)
    stored = spark.read.parquet(f"{path}/items")
    near = stored.where(F.col("part").isin(parts_of_items))
    old = written(near.join(ids, "document_id", "left_semi").drop("part"), "old")
    clusters = written(old.select("cluster_id").union(fresh.select("cluster_id")).distinct(), "clusters")
    parts_of_elections = _touched(clusters, parts)

    elections = spark.read.parquet(f"{path}/elections").where(F.col("part").isin(parts_of_elections))
    members = written(elections.join(clusters, "cluster_id", "left_semi"), "members")
    kept = members.join(ids, "document_id", "left_anti").drop("part", "canonical_id")
    chosen = written(elect(kept.unionByName(fresh.select(*kept.columns))), "chosen")
    others = elections.join(clusters, "cluster_id", "left_anti")
    _replace(others.unionByName(chosen.withColumn("part", _part("cluster_id", parts)).select(*others.columns)), f"{path}/elections", parts_of_elections)
    rest = near.join(ids, "document_id", "left_anti")
    _replace(rest.unionByName(fresh.withColumn("part", _part("document_id", parts)).select(*rest.columns)), f"{path}/items", parts_of_items)

    before = members.groupBy("cluster_id").agg(F.first("canonical_id").alias("previous"))
    after = chosen.groupBy("cluster_id").agg(F.first("canonical_id").alias("canonical_id"))
    changed = before.join(after, "cluster_id", "full").where(~F.col("previous").eqNullSafe(F.col("canonical_id")))
    gone = old.join(fresh.select("item_id"), "item_id", "left_anti")
    removed = gone.select(F.lit("knowledge_item").alias("source_type"), F.col("item_id").alias("source_id"), F.lit("removed").alias("reason"))
    return Rerun(removed, changed.select("cluster_id", "previous", "canonical_id"))


def patched(documents: DataFrame, patches: DataFrame, kinds: list[str]) -> DataFrame:
    """Documents with their corrections, and what follows: problem, date_moved, runs_again, former_date.

    documents: document_id, doc_type, doc_kind, effective_date, effective_date_source, buyer, submission_date,
    confirmed. patches: document_id, at, changes map<string,string> (a blank or null value clears a field); of several for
    one document the last. A patch is refused whole, with its first problem, where it names an unknown field, a type or
    kind outside the lists, a day that is none, clears the effective date, or leaves a reference without a kind. Another
    type makes the document run again; a document that is no reference loses its kind unless the patch gives one.
    """
    last = patches.groupBy("document_id").agg(F.max_by("changes", F.struct("at", F.to_json("changes"))).alias("changes"))
    rows = documents.join(last, "document_id", "left").withColumn("changes", F.transform_values("changes", lambda k, v: F.when(strip(v) != "", strip(v))))
    names = F.coalesce(F.map_keys("changes"), F.array().cast("array<string>"))
    has, value = lambda f: F.array_contains(names, f), lambda f: F.try_element_at("changes", F.lit(f))
    new = lambda f: F.when(has(f), value(f)).otherwise(F.col(f))
    day = lambda f: F.when(value(f).rlike(DAY), F.try_to_date(value(f), "yyyy-MM-dd"))
    no_day = lambda f: has(f) & value(f).isNotNull() & day(f).isNull()
    kind = F.when(has("doc_kind"), value("doc_kind")).when(F.col("doc_type") == "reference", F.col("doc_kind"))
    problem = (
        F.when(F.exists(names, lambda n: ~n.isin(FIELDS)), "unknown field")
        .when(has("doc_type") & ~F.coalesce(value("doc_type").isin(DOC_TYPES), F.lit(False)), "doc_type")
        .when(has("doc_kind") & value("doc_kind").isNotNull() & ~value("doc_kind").isin(kinds), "doc_kind")
        .when(no_day("effective_date"), "effective_date")
        .when(no_day("submission_date"), "submission_date")
        .when(has("effective_date") & value("effective_date").isNull(), "effective_date cleared")
        .when((new("doc_type") == "reference") & kind.isNull(), "reference without a kind")
    )
    rows = rows.withColumn("problem", F.when(F.col("changes").isNotNull(), problem)).withColumn("_act", F.col("changes").isNotNull() & F.col("problem").isNull())
    act = lambda c, old: F.when(F.col("_act"), c).otherwise(F.col(old))
    moved = F.col("_act") & has("effective_date") & ~day("effective_date").eqNullSafe(F.col("effective_date"))
    again = F.col("_act") & ~new("doc_type").eqNullSafe(F.col("doc_type"))
    new_kind = F.when(has("doc_kind"), value("doc_kind")).when(new("doc_type").eqNullSafe(F.lit("reference")), F.col("doc_kind"))
    # every new value is worked out from the old row, then they take their places together
    values = {
        "doc_type": act(new("doc_type"), "doc_type"), "doc_kind": act(new_kind, "doc_kind"), "buyer": act(new("buyer"), "buyer"),
        "effective_date": act(F.when(has("effective_date"), day("effective_date")).otherwise(F.col("effective_date")), "effective_date"),
        "effective_date_source": F.when(moved, "user").otherwise(F.col("effective_date_source")),
        "submission_date": act(F.when(has("submission_date"), day("submission_date")).otherwise(F.col("submission_date")), "submission_date"),
        "confirmed": F.col("_act") | F.coalesce("confirmed", F.lit(False)), "former_date": F.col("effective_date"), "date_moved": moved, "runs_again": again,
    }
    return rows.withColumns(values).drop("changes", "_act")


def facts_moved(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with the dates of their documents after `patched`: those dated exactly the former date follow.

    facts: document_id, effective_date and any others. A document that runs again has its facts made anew, so its
    present ones stay; a document without a former date moves none.
    """
    dates = documents.where("date_moved and not runs_again").select("document_id", "former_date", F.col("effective_date").alias("_to"))
    rows = facts.join(dates, "document_id", "left")
    return rows.withColumn("effective_date", moved_date(F.col("effective_date"), F.col("former_date"), F.col("_to"))).drop("former_date", "_to")
