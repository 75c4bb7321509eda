"""Supersession of documents with human decisions, to a fixed point, and what follows from each change.

A document of a supersedable kind is superseded where a standing decision says so, or where a live one of its
organisation and kind has a later date and no standing decision is about the two. Live means: not superseded
itself. Live documents are found from the latest date down: each round makes a group's latest open documents live and
closes all earlier ones that are not kept beside every one of them. Later rounds hold only documents that
decisions keep beside others, so their number is bounded by the decisions, and each is one written table.

A decision is removed where one of its documents is no longer supersedable or of the recorded kind, and reset to the
automatic outcome where a date changed after it. What changes against the documents' present pointers is told
as events: a newly superseded document hides its items and makes its current facts stale, a reversed one
gives its items back, and a pointer that only moves tells nothing. So a second run over the results changes nothing.

Nulls: documents without a date, or dated by upload, are superseded by decisions alone; null ids are ignored.
Ties: documents of the latest date stand side by side; the pointer goes to the newest superseder, then the
greatest id. Of several decisions about one pair the last decided stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import KEYED_DOC_KINDS, SUPERSEDABLE_DOC_KINDS
from .components import written


@dataclass
class Outcome:
    """pointers: document_id, superseded_by. decisions: a_id, b_id, state (stands, reset, removed). items: item_id,
    document_id, excluded. events: document_id, event, superseded_by, previous, reason, n_items, n_facts."""

    pointers: DataFrame
    decisions: DataFrame
    items: DataFrame
    events: DataFrame


def decision_states(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (a_id, b_id, doc_kind, newer_id or null, decided_at), the last of each pair, with state."""
    able = _able(documents).select("document_id", "org_id", F.col("doc_kind").alias("kind"), "date_changed_at")
    pair = F.struct(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"))
    last = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("decided_at"), F.desc("newer_id")))
    one = decisions.where("a_id is not null and b_id is not null and a_id <> b_id").withColumn("pair", pair).withColumn("n", last).where("n = 1")
    side = lambda c: able.select(F.col("document_id").alias(f"{c}_id"), F.struct("org_id", "kind", "date_changed_at").alias(c))
    both = one.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    valid = (F.col("a.org_id") == F.col("b.org_id")) & (F.col("a.kind") == F.col("doc_kind")) & (F.col("b.kind") == F.col("doc_kind"))
    valid = valid & (F.col("newer_id").isNull() | F.col("newer_id").isin(F.col("a_id"), F.col("b_id")))
    late = lambda c: F.coalesce(F.col(f"{c}.date_changed_at") > F.col("decided_at"), F.lit(False))
    state = F.when(~F.coalesce(valid, F.lit(False)), "removed").when(late("a") | late("b"), "reset").otherwise("stands")
    return both.select("a_id", "b_id", "doc_kind", "newer_id", "decided_at", state.alias("state"))


def _able(documents: DataFrame) -> DataFrame:
    return documents.where((F.col("doc_type") == "reference") & F.col("doc_kind").isin(SUPERSEDABLE_DOC_KINDS) & F.col("confirmed"))


def superseders(documents: DataFrame, standing: DataFrame) -> DataFrame:
    """document_id, superseded_by of all that are superseded; standing: a_id, b_id, newer_id."""
    dates = documents.select(F.col("document_id").alias("newer_id"), "effective_date")
    told = standing.where("newer_id is not null").select(F.when(F.col("newer_id") == F.col("a_id"), F.col("b_id")).otherwise(F.col("a_id")).alias("document_id"), "newer_id")
    newest = F.max(F.struct("effective_date", "newer_id")).alias("best")
    told = told.join(dates, "newer_id").groupBy("document_id").agg(newest).select("document_id", F.col("best.newer_id").alias("superseded_by"))
    told = written(told, "told")
    kept = standing.select(F.col("a_id").alias("document_id"), F.col("b_id").alias("partner_id")).union(standing.select("b_id", "a_id"))
    dated = _able(documents).where(F.col("effective_date").isNotNull() & (F.coalesce("date_source", F.lit("")) != "upload_time") & ~F.col("doc_kind").isin(KEYED_DOC_KINDS))
    open_ = written(dated.join(told, "document_id", "left_anti").select("document_id", "org_id", "doc_kind", "effective_date"), "open")
    group, found = ["org_id", "doc_kind"], told
    while True:
        top = open_.groupBy(*group).agg(F.max("effective_date").alias("top"))
        tagged = open_.join(top, group)
        down = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("leader_id")))
        live = tagged.where("effective_date = top").select(*group, F.col("document_id").alias("leader_id"))
        heads = live.groupBy(*group).agg(F.count("*").alias("n"), F.max("leader_id").alias("first"))
        rest = tagged.where("effective_date < top").join(heads, group)
        beside = kept.join(rest.select("document_id", *group), "document_id").join(live.withColumnRenamed("leader_id", "partner_id"), ["partner_id", *group])
        beside = beside.groupBy("document_id").agg(F.collect_set("partner_id").alias("beside"))
        rest = written(rest.join(beside, "document_id", "left").withColumn("beside", F.coalesce("beside", F.array().cast("array<long>"))), "rest")
        # of leaders in descending order, one of the first so many and one more is not among those it is kept beside
        few = rest.where((F.size("beside") > 0) & (F.size("beside") < F.col("n")))
        best = few.join(live.withColumn("place", down), group)
        best = best.where((F.col("place") <= F.size("beside") + 1) & ~F.array_contains("beside", F.col("leader_id"))).groupBy("document_id").agg(F.max("leader_id").alias("superseded_by"))
        plain = rest.where(F.size("beside") == 0).select("document_id", F.col("first").alias("superseded_by"))
        found = found.union(plain).union(best)
        open_ = rest.where(F.size("beside") == F.col("n")).select("document_id", *group, "effective_date")
        if open_.isEmpty():
            return written(found, "superseded")


def supersede(documents: DataFrame, decisions: DataFrame, items: DataFrame, facts: DataFrame) -> Outcome:
    """The new pointers, decisions, items and the events of a run.

    documents: document_id, org_id, doc_type, doc_kind, confirmed, effective_date, date_source, date_changed_at (null or
    when its date last changed), superseded_by (the present pointer). items: item_id, document_id, excluded.
    facts: fact_id, document_id, current (not replaced or expired on their own account).
    """
    states = written(decision_states(documents, decisions), "decisions")
    now = superseders(documents, states.where("state = 'stands'").select("a_id", "b_id", "newer_id"))
    moved = documents.select("document_id", F.col("superseded_by").alias("previous")).join(now, "document_id", "left")
    about = states.select(F.col("a_id").alias("document_id"), F.col("b_id").alias("previous"), "state").union(states.select("b_id", "a_id", "state"))
    why = F.when(F.col("state") == "stands", "keep_both").when(F.col("state") == "reset", "date_changed").when(F.col("state") == "removed", "decision_removed").otherwise("re_evaluated")
    event = F.when(F.col("previous").isNull() & F.col("superseded_by").isNotNull(), "document_superseded").when(F.col("previous").isNotNull() & F.col("superseded_by").isNull(), "supersession_reversed")
    moved = moved.join(about, ["document_id", "previous"], "left").withColumn("event", event)
    moved = moved.withColumn("reason", F.when(F.col("event") == "supersession_reversed", why))
    moved = written(moved.select("document_id", "previous", "superseded_by", "event", "reason"), "moved")
    hidden = F.when(F.col("superseded_by").isNotNull(), True).when(F.col("event") == "supersession_reversed", False).otherwise(F.coalesce("excluded", F.lit(False)))
    both = items.select("item_id", "document_id", "excluded").join(moved, "document_id", "left").withColumn("now", hidden)
    changed = both.where(F.col("now") != F.coalesce("excluded", F.lit(False))).groupBy("document_id").agg(F.count("*").alias("n_items"))
    stale = facts.where("current").join(moved.where("event = 'document_superseded'").select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n_facts"))
    none = F.lit(0).cast("long")
    events = (
        moved.where("event is not null")
        .join(changed, "document_id", "left")
        .join(stale, "document_id", "left")
        .select("document_id", "event", "superseded_by", "previous", "reason", F.coalesce("n_items", none).alias("n_items"), F.coalesce("n_facts", none).alias("n_facts"))
    )
    return Outcome(moved.select("document_id", "superseded_by"), states, both.select("item_id", "document_id", F.col("now").alias("excluded")), events)
