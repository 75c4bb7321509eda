"""Clusters, facts and documents over time: election, supersession, invalidation.

All are recomputed from the whole tables; nothing is patched in place. `today` is always a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, KEYED_DOC_KINDS, SUPERSEDABLE_DOC_KINDS
from .components import connected_components, in_order, written

#: Vectors of a block of similar_pairs: two blocks meet in a task, and each vector is sent to as many tasks as its group has blocks.
BLOCK = 8192


def elect(items: DataFrame) -> DataFrame:
    """Adds canonical_id: of each cluster, promoted answers first, newest date (null last), oldest, id.

    items: item_id, cluster_id, promoted, effective_date, created_at. One aggregation, no sort of groups.
    """
    key = F.struct(
        (~F.coalesce("promoted", F.lit(False))).alias("a"),
        (-F.coalesce(F.unix_date("effective_date"), F.lit(-(2**30)))).alias("b"),
        F.coalesce("created_at", F.timestamp_seconds(F.lit(253402300799))).alias("c"),
        F.col("item_id").alias("d"),
    )
    best = items.groupBy("cluster_id").agg(F.min_by("item_id", key).alias("canonical_id"))
    return items.join(best, "cluster_id")


def siblings(items: DataFrame) -> DataFrame:
    """item_id, sibling_id: members of the same cluster, not oneself."""
    own = items.select("item_id", F.coalesce("canonical_id", "item_id").alias("cluster_id"))
    return own.join(own.withColumnRenamed("item_id", "sibling_id"), "cluster_id").where("item_id <> sibling_id").select("item_id", "sibling_id")


def similar_pairs(items: DataFrame, least: float = DEFAULTS.dedup_threshold) -> DataFrame:
    """a, b (a < b) of one group with cosine >= least, exact: blocks of a group are multiplied pair by pair.

    items: item_id, grp, vector. Null and zero vectors are left out.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = items.where(F.col("vector").isNotNull()).where(square > 0)
    blocks = good.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = (
        good.join(blocks, "grp")
        .withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .select("grp", "lo", "hi", "block", "item_id", "vector")
    )

    def pairs(cell: pa.Table) -> pa.Table:
        x, ids = _unit(cell["vector"]), cell["item_id"].to_numpy()
        lo = cell["block"].to_numpy() == cell["lo"][0].as_py()
        across = cell["lo"][0].as_py() != cell["hi"][0].as_py()
        left, right = np.flatnonzero(lo), np.flatnonzero(~lo if across else lo)
        # single precision rules out what is farther off than its error; what is left is compared in double precision
        rough, margin = x.astype(np.float32), 1e-6 + 2.4e-7 * x.shape[1]
        across_from = rough[right].T.copy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), 512):
            i, j = np.nonzero(rough[left[at : at + 512]] @ across_from >= np.float32(least - margin))
            i, j = left[at + i], right[j]
            keep = np.einsum("ij,ij->i", x[i], x[j]) >= least
            keep &= ids[i] != ids[j] if across else ids[i] < ids[j]
            a.append(np.minimum(ids[i[keep]], ids[j[keep]]))
            b.append(np.maximum(ids[i[keep]], ids[j[keep]]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return cells.groupBy("grp", "lo", "hi").applyInArrow(pairs, "a long, b long")


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    x = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leader_clusters(items: DataFrame, least: float = DEFAULTS.dedup_threshold) -> DataFrame:
    """item_id, canonical_id of sequential leader clustering in the order of (created_at, item_id).

    An item joins the cluster of the nearest present canonical at `least` or more; the cluster then
    elects its canonical anew. Items that are never within reach of each other can't meet, so the fold
    runs by connected component of the similarity graph, not over a whole group.
    items: item_id, grp, vector, promoted, effective_date, created_at.
    """
    pairs = written(similar_pairs(items, least), "pairs")
    parts = connected_components(pairs, "reach").select(F.col("node").alias("item_id"), F.col("root").alias("part"))
    linked = items.join(parts, "item_id").select("part", "item_id", "vector", "promoted", "effective_date", "created_at")

    def fold(x: np.ndarray, place: list[tuple]) -> list[int]:
        """For each item of a part, in order, the row of its cluster's canonical; place: their order as canonicals."""
        heads, own = [], []
        for i in range(len(x)):
            near = x[heads] @ x[i] if heads else np.zeros(0)
            if len(near) and near.max() >= least:
                c = int(near.argmax())
                heads[c] = min(heads[c], i, key=place.__getitem__)
            else:
                c = len(heads)
                heads.append(i)
            own.append(c)
        return [heads[c] for c in own]

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not len(batch):
                continue
            part = batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            if held and held[-1]["part"][-1].as_py() == part[0]:
                held.append(batch.slice(0, cuts[1]))
                cuts = cuts[1:]
            if len(cuts) > 1:
                # all parts but the last are whole
                yield from canonicals([*held, batch.slice(cuts[0], cuts[-2] - cuts[0])])
                held = [batch.slice(cuts[-2])]
        yield from canonicals(held)

    def canonicals(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if batches else None
        if not rows:
            return
        part, ids, x = rows["part"].to_numpy(), rows["item_id"].to_numpy(), _unit(rows["vector"])
        key = [rows["promoted"], pc.cast(rows["effective_date"], pa.int32()), pc.cast(rows["created_at"], pa.int64()), rows["item_id"]]
        place = [(not p, -d if d is not None else math.inf, t if t is not None else math.inf, i) for p, d, t, i in zip(*(k.to_pylist() for k in key))]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        head = [lo + h for lo, hi in zip(cuts, cuts[1:]) for h in fold(x[lo:hi], place[lo:hi])]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[head])], ["item_id", "canonical_id"])

    ordered = in_order(linked, ["part"], F.col("created_at").asc_nulls_last(), F.col("item_id"))
    folded = ordered.mapInArrow(parts_of, "item_id long, canonical_id long")
    return items.select("item_id").join(folded, "item_id", "left").select("item_id", F.coalesce("canonical_id", "item_id").alias("canonical_id"))


def fact_is_current(today: Column) -> Column:
    """Over superseded_by, expired_at, expires_on and document_superseded_by."""
    open_ended = F.col("expires_on").isNull() | (F.col("expires_on") >= today)
    return F.col("superseded_by").isNull() & F.col("expired_at").isNull() & open_ended & F.col("document_superseded_by").isNull()


def stale_reason(today: Column, known: Column) -> Column:
    """removed, superseded or expired, in that order; null while the fact is current."""
    gone = F.col("superseded_by").isNotNull() | F.col("document_superseded_by").isNotNull()
    over = F.col("expired_at").isNotNull() | (F.col("expires_on") < today)
    return F.when(~known, "removed").when(gone, "superseded").when(over, "expired")


def current_facts(facts: DataFrame) -> DataFrame:
    """The most current fact of each (kind, key); null keys are one key.

    Reference documents first, dates of their own before inherited upload dates, newest date, id.
    """
    inherited = (F.col("date_source") == "upload_time") & (F.col("effective_date") == F.col("document_date"))
    w = Window.partitionBy("kind", "key").orderBy(
        F.when(F.col("doc_type") == "reference", 0).otherwise(1), F.coalesce(inherited, F.lit(False)), F.desc("effective_date"), "fact_id"
    )
    return facts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def fact_successors(facts: DataFrame) -> DataFrame:
    """fact_id, superseded_by: the latest-dated fact of the same kind and key that may supersede it.

    Gate: another document of the same type, both confirmed, neither dated by upload, dates differ.
    facts: fact_id, kind, key, document_id, doc_type, confirmed, date_source, effective_date, created_at.

    A later fact beats all others of its group unless gated, so each group needs only the best two
    documents of every (kind, key, doc_type): the join partner is at most two rows, not the group.
    """
    dated = facts.where(F.col("confirmed") & (F.col("date_source") != "upload_time") & F.col("doc_type").isNotNull())
    recency = F.struct("effective_date", "created_at", "fact_id")
    per_doc = dated.groupBy("kind", "key", "doc_type", "document_id").agg(F.max(recency).alias("best"))
    w = Window.partitionBy("kind", "key", "doc_type").orderBy(F.desc("best"))
    top = per_doc.withColumn("n", F.row_number().over(w)).where("n <= 2").select(
        F.col("kind").alias("k"), F.col("key").alias("y"), F.col("doc_type").alias("t"), F.col("document_id").alias("d"), "best"
    )
    f = dated.select("fact_id", "kind", "key", "doc_type", "document_id", "effective_date")
    able = F.col("kind").eqNullSafe(F.col("k")) & F.col("key").eqNullSafe(F.col("y")) & (F.col("doc_type") == F.col("t")) & (F.col("document_id") != F.col("d")) & (F.col("best.effective_date") > F.col("effective_date"))
    found = f.join(top, able).groupBy("fact_id").agg(F.max("best").alias("best"))
    return facts.select("fact_id").join(found, "fact_id", "left").select("fact_id", F.col("best.fact_id").alias("superseded_by"))


def pair_outcome(kind: Column, date_a: Column, date_b: Column, source_a: Column, source_b: Column) -> Column:
    """struct<decision, reason, newer> for a document pair of one kind; newer is 'a' or 'b'."""
    s = lambda d, r, n: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"), F.lit(n).cast("string").alias("newer"))
    undated = (source_a == "upload_time") | (source_b == "upload_time") | date_a.isNull() | date_b.isNull()
    return (
        F.when(kind.isin(KEYED_DOC_KINDS), s("pending", "keyed_kind", None))
        .when(F.coalesce(undated, F.lit(False)), s("pending", "pending_date", None))
        .when(date_a == date_b, s("pending", "tie", None))
        .when(date_a < date_b, s("superseded", "auto", "b"))
        .otherwise(s("superseded", "auto", "a"))
    )


def document_supersession(documents: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """document_id, superseded_by: the newest document that supersedes it.

    Automatic outcomes hold where no human decision (a_id, b_id, newer_id or null) stands against them.
    Each kind's dated documents need only the newest partner, so no pairs of a kind are made; human
    decisions are joined as the rows they are.
    documents: document_id, org_id, doc_type, doc_kind, confirmed, effective_date, date_source.
    """
    able = documents.where((F.col("doc_type") == "reference") & F.col("doc_kind").isin(SUPERSEDABLE_DOC_KINDS) & F.col("confirmed"))
    dated = able.where(F.col("effective_date").isNotNull() & (F.col("date_source") != "upload_time") & ~F.col("doc_kind").isin(KEYED_DOC_KINDS))
    newest = dated.groupBy("org_id", "doc_kind").agg(F.max(F.struct("effective_date", "document_id")).alias("newest"))
    auto = dated.join(newest, ["org_id", "doc_kind"]).where(F.col("newest.effective_date") > F.col("effective_date")).select(
        "document_id", F.col("newest.document_id").alias("newer_id"), F.col("newest.effective_date").alias("newer_date")
    )
    if decisions is None:
        return documents.select("document_id").join(auto.select("document_id", F.col("newer_id").alias("superseded_by")), "document_id", "left")
    d = decisions.select("a_id", "b_id", "newer_id")
    both = d.select(F.col("a_id").alias("document_id"), F.col("b_id").alias("partner_id"), "newer_id").union(d.select("b_id", "a_id", "newer_id"))
    # with decisions every pair of the documents that have one is looked at; the others keep the newest
    touched = dated.join(both.select("document_id").distinct(), "document_id")
    pairs = touched.alias("x").join(dated.alias("y"), (F.col("x.org_id") == F.col("y.org_id")) & (F.col("x.doc_kind") == F.col("y.doc_kind")) & (F.col("y.effective_date") > F.col("x.effective_date")))
    pairs = pairs.select(F.col("x.document_id").alias("document_id"), F.col("y.document_id").alias("partner_id"), F.col("y.effective_date").alias("newer_date"))
    kept = pairs.join(both.select("document_id", "partner_id"), ["document_id", "partner_id"], "left_anti").select("document_id", F.col("partner_id").alias("newer_id"), "newer_date")
    by_hand = both.where("newer_id = partner_id").join(documents.select(F.col("document_id").alias("newer_id"), F.col("effective_date").alias("newer_date")), "newer_id").select("document_id", "newer_id", "newer_date")
    rest = auto.join(both.select("document_id").distinct(), "document_id", "left_anti")
    best = rest.unionByName(kept).unionByName(by_hand).groupBy("document_id").agg(F.max(F.struct("newer_date", "newer_id")).alias("best"))
    return documents.select("document_id").join(best, "document_id", "left").select("document_id", F.col("best.newer_id").alias("superseded_by"))


def expired(facts: DataFrame, today: Column) -> DataFrame:
    """Facts that the sweep marks today: past their expiry and not marked yet."""
    return facts.where((F.col("expires_on") < today) & F.col("expired_at").isNull())


def inherited_date(fact_date: Column, document_date: Column, created_at: Column) -> Column:
    return F.coalesce(fact_date, document_date, F.to_date(created_at))


def moved_date(fact_date: Column, old: Column, new: Column) -> Column:
    """Facts dated exactly the document's old date follow it."""
    return F.when(fact_date == old, new).otherwise(fact_date)


def renumbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """order_index from 0 within each group."""
    return rows.withColumn("order_index", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
