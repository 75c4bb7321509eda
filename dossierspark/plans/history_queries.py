"""Requirements merged with a later run, and the log of events, on line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import merging
from ..operators.components import scratch, written
from .registry import query, table


@query(
    """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) % 4 AS k, min(l_returnflag) = 'R' AS touched FROM lineitem GROUP BY ALL),
s AS (SELECT *, o * 10 + n AS id, n * 100 + CASE k WHEN 1 THEN 10 WHEN 2 THEN 60 ELSE 0 END AS a, CASE WHEN touched THEN 'ann' END AS owner FROM l)
SELECT CASE WHEN k < 2 THEN id END AS requirement_id, 'o' || o || ':' || a || '-' || (a + 80) AS key, CASE WHEN k < 2 THEN owner END AS owner,
  CAST(row_number() OVER (PARTITION BY o // 100 ORDER BY id) - 1 AS INTEGER) AS order_index, CASE WHEN k < 2 THEN 'updated' ELSE 'created' END AS state FROM s WHERE k < 3
UNION ALL SELECT id, 'o' || o || ':' || n * 100 || '-' || (n * 100 + 80), owner, NULL, CASE WHEN o % 5 > 0 AND NOT touched THEN 'deleted' ELSE 'kept' END FROM s WHERE k > 1"""
)
def merged_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed, overlapping, new, kept and deleted requirements of a run over each order."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy(o, n).agg((F.min("l_partkey") % 4).alias("k"), (F.min("l_returnflag") == "R").alias("touched"))
    lines = written(lines, "lines")
    section = F.concat(F.lit("o"), o.cast("string"))

    def span(shift) -> list:
        start = (n * 100 + shift).cast("int")
        key = F.concat(section, F.lit(":"), start.cast("string"), F.lit("-"), (start + 80).cast("string"))
        return [section.alias("section_id"), key.alias("key"), start.alias("start"), (start + 80).alias("end")]

    ids, tender = o * 10 + n, F.floor(o / 100).alias("tender_id")
    human = [F.when(F.col("touched"), "ann").alias("owner")] + [F.lit(None).cast("string").alias(c) for c in merging.HUMAN if c != "owner"]
    stored = lines.select(ids.alias("requirement_id"), tender, *span(0), *human)
    found = lines.where("k < 3").select(ids.alias("new_id"), tender, ids.alias("position"), *span(F.when(F.col("k") == 1, 10).when(F.col("k") == 2, 60).otherwise(0)))
    covered = lines.where(o % 5 > 0).select(section.alias("section_id"))
    return merging.merge_requirements(stored, found, covered).select("requirement_id", "key", "owner", "order_index", "state")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, CAST(event_id AS VARCHAR)) AS seq,
  CAST(event_id AS VARCHAR) AS key, event_id % 3 AS batch, CASE event_id % 4 WHEN 0 THEN 'attested' WHEN 1 THEN 'disputed' WHEN 2 THEN 'comment_added' ELSE 'assigned' END AS event_type FROM events"""
)
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in three batches, two of them twice; each entity's numbers have no gap."""
    k = F.col("event_id")
    kind = F.when(k % 4 == 0, "attested").when(k % 4 == 1, "disputed").when(k % 4 == 2, "comment_added").otherwise("assigned")
    rows = table(spark, sf_dir, "events").select(
        k, F.lit("question").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"), kind.alias("event_type"), F.lit("ann").alias("actor"),
        k.cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("payload"),
    )
    path = scratch(spark, "event-log")
    for batch in (0, 0, 1, 2, 2):
        E.append(rows.where(k % 3 == batch), path, batch)
    return E.read_log(spark, path).select("entity_id", "seq", "key", "batch", "event_type")
