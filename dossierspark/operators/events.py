"""An append-only log of events with a sequence for each entity that has no gaps and survives replays.

A batch of events is one folder of the log, written as a whole: a batch that runs again writes the same folder
anew. Sequences go on from the heads, a small table beside the log with the last number of every entity that a
batch touched. An event whose key the log has from another batch is not written again.

events: entity_type, entity_id, event_type, actor, key (unique for each thing that happened), at, payload (JSON).
Unknown types and blank actors are refused before anything is written. Within an entity, events of a batch are
numbered by (at, key). Empty batches write empty folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .components import written

# What an event can be about, and what can have happened.
ENTITY_TYPES = ["question", "answer", "document", "tender", "fact", "job", "thread", "supersession_decision", "knowledge_item", "requirement"]
EVENT_TYPES = [
    "status_changed", "assigned", "answer_created", "answer_saved_from_chat", "verbatim_accepted", "comment_added",
    "document_superseded", "supersession_decided", "pair_fixed", "fact_superseded", "fact_expired", "answer_needs_review",
    "attested", "disputed", "gap_acknowledged", "compliance_class_set", "evidence_added", "job_failed", "answer_promoted",
    "tender_submitted", "outcome_set", "supersession_reversed", "requirement_rated",
]
SYSTEM = "system"
EVENT = "entity_type string, entity_id string, event_type string, actor string, key string, at timestamp, payload string"
NAMES = [c.split()[0] for c in EVENT.split(", ")]
#: Folders of heads: a batch reads the heads of the entities it touches by these alone.
SHARDS = 64


def _shard() -> Column:
    return F.pmod(F.xxhash64("entity_type", "entity_id"), F.lit(SHARDS)).cast("int")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All events with seq (from 1 within the entity) and batch."""
    return spark.read.schema(f"{EVENT}, seq long, batch long").parquet(f"{path}/log")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append(events: DataFrame, path: str, batch: int) -> None:
    """Write a batch; batches come in ascending order, and one may come again before the next does."""
    spark = events.sparkSession
    rows = written(events.select(*NAMES).withColumn("actor", strip(F.col("actor"))), "events")
    known = F.col("entity_type").isin(ENTITY_TYPES) & F.col("event_type").isin(EVENT_TYPES) & (F.col("actor") != "") & F.col("entity_id").isNotNull() & F.col("key").isNotNull()
    bad = rows.where(~F.coalesce(known, F.lit(False))).first()
    if bad is not None:
        raise ValueError(f"not an event: {bad.asDict()}")
    one = F.row_number().over(Window.partitionBy("key").orderBy("at", *NAMES[:4], F.xxhash64("payload")))
    rows = rows.withColumn("_n", one).where("_n = 1").drop("_n")
    entity = ["entity_type", "entity_id"]
    if _there(spark, f"{path}/log"):
        before = read_log(spark, path).where(F.col("batch") < batch)
        rows = rows.join(before.select("key"), "key", "left_anti")
    last = F.lit(0).cast("long")
    if _there(spark, f"{path}/heads"):
        heads = spark.read.schema("entity_type string, entity_id string, last long, batch long, shard int").parquet(f"{path}/heads")
        heads = heads.where(F.col("batch") < batch).join(rows.select(_shard().alias("shard"), *entity).distinct(), ["shard", *entity], "left_semi")
        rows, last = rows.join(heads.groupBy(*entity).agg(F.max("last").alias("last")), entity, "left"), F.coalesce("last", F.lit(0))
    at = F.row_number().over(Window.partitionBy(*entity).orderBy("at", "key"))
    numbered = written(rows.select(*NAMES, (last + at).alias("seq")), "numbered")
    # the log last: a batch that stops between the two writes runs again and replaces its heads
    numbered.groupBy(*entity).agg(F.max("seq").alias("last")).withColumn("shard", _shard()).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/heads/batch={batch}")
    numbered.write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """A query that appends a stream of events and ends when it has read what is there; replays add nothing."""
    return events.writeStream.foreachBatch(lambda rows, batch: append(rows, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _event(rows: DataFrame, entity: str, entity_id: Column, kind: Column, actor: Column, at: Column, key: list, *payload: str) -> DataFrame:
    parts = [entity_id.cast("string"), kind, *[F.coalesce(k.cast("string"), F.lit("")) for k in key]]
    return rows.select(
        F.lit(entity).alias("entity_type"), entity_id.cast("string").alias("entity_id"), kind.alias("event_type"), actor.alias("actor"),
        F.sha2(F.to_json(F.array(*parts)), 256).alias("key"), at.alias("at"), F.to_json(F.struct(*payload)).alias("payload"),
    )


def of_actions(acted: DataFrame, actions: DataFrame, at: Column) -> DataFrame:
    """Events of answers.act: attested and disputed sentences, by their actors. actions: as answers.act has them."""
    done = acted.select("answer_id", F.inline("events")).where("outcome in ('attested', 'disputed')")
    who = actions.groupBy("answer_id", "index").agg(F.min(F.struct("action", "actor", "note")).alias("a")).select("answer_id", "index", "a.actor")
    return _event(done.join(who, ["answer_id", "index"]), "answer", F.col("answer_id"), F.col("outcome"), F.col("actor"), at, [F.col("index"), at], "index")


def of_invalidations(changed: DataFrame, at: Column) -> DataFrame:
    """Events of verification.invalidation_effects: one for each answer's question."""
    told = changed.where("size(changed) > 0 or n_checklist > 0").withColumn("segment_indices", F.col("changed"))
    return _event(told, "question", F.col("question_id"), F.lit("answer_needs_review"), F.lit(SYSTEM), at, [F.col("answer_id"), at], "answer_id", "segment_indices")


def of_supersession(events: DataFrame, at: Column) -> DataFrame:
    """Events of supersession.supersede."""
    return _event(events, "document", F.col("document_id"), F.col("event"), F.lit(SYSTEM), at, [at], "superseded_by", "previous", "reason", "n_items", "n_facts")


def of_ratings(rated: DataFrame, at: Column) -> DataFrame:
    """Events of answers.rate_requirements: changed classes, by who set them (a cleared one by the system)."""
    return _event(rated.where("changed"), "requirement", F.col("requirement_id"), F.lit("requirement_rated"), F.coalesce("rated_by", F.lit(SYSTEM)), at, [at], "previous", "compliance_class")


def of_promotions(promoted: DataFrame, at: Column) -> DataFrame:
    """Events of answers.promote."""
    return _event(promoted, "answer", F.col("answer_id"), F.lit("answer_promoted"), F.lit(SYSTEM), at, [], "pack_id", "question_id")
