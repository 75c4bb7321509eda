"""Evaluation metrics on labels, events, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query, table


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("guess"))
    return docs.join(table(spark, sf, "labels"), "doc_id")


@query("SELECT quality AS truth, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def coverage_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of labels and a guess by length."""
    return M.confusion(_labelled(spark, sf_dir), "quality", "guess")


@query(
    """SELECT count(*) FILTER (quality IS NOT NULL) AS n_both, count(*) FILTER (quality = CASE WHEN n_chars > 300 THEN 1 ELSE 0 END) AS n_equal,
  count(*) FILTER (quality = CASE WHEN n_chars > 300 THEN 1 ELSE 0 END) / count(*) FILTER (quality IS NOT NULL) AS share FROM documents JOIN labels USING (doc_id)"""
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement share."""
    return M.agreement(_labelled(spark, sf_dir), "quality", "guess")


@query(
    """SELECT l AS label, count(o_orderkey) AS n, count(o_orderkey) / (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')) AS share
FROM (SELECT unnest(['O', 'F', 'P', 'X']) AS l) LEFT JOIN orders ON o_orderstatus = l GROUP BY l"""
)
def coverage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a fixed label list, zero-filled."""
    return M.label_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F", "P", "X"])


@query("SELECT event_type, count(value) AS n, min(value) AS least, median(value) AS median, max(value) AS most FROM events GROUP BY 1")
def best_vec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score summary by label."""
    return M.score_summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return M.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}).drop("mean")


@query(
    """SELECT l_returnflag AS item_type, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS verified, count(*) FILTER (l_linestatus = 'O') / count(*) AS fidelity,
  count(*) FILTER (l_linestatus = 'O') / count(*) >= 0.9 AS meets_target FROM lineitem GROUP BY 1"""
)
def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return M.extraction_totals(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("item_type"), (F.col("l_linestatus") == "O").alias("text_verified")))


@query(
    """SELECT l_returnflag AS stratum, count(*) AS n, sum(l_linenumber % 5 + 1) / count(*) AS mean, """
    + ", ".join(f"count(*) FILTER (l_linenumber % 5 + 1 = {k}) AS n_{k}" for k in range(1, 6))
    + " FROM lineitem GROUP BY 1"
)
def draft_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stratum"), (F.col("l_linenumber") % 5 + 1).alias("rating"))
    return M.draft_quality(rows, "stratum", "rating")


@query(
    """SELECT o_orderpriority, count(*) AS substantive, count(*) FILTER (l_returnflag = 'R') AS supported, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS verbatim,
  CAST(sum(CASE WHEN l_discount > 0.05 THEN 0 ELSE 1 END) AS BIGINT) AS near, count(*) FILTER (l_returnflag = 'R') / count(*) AS share
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' GROUP BY 1"""
)
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported share and sources by tier."""
    seg = F.struct(
        F.when(F.col("l_linestatus") == "O", "substantive").otherwise("connective").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "supported").otherwise("weak").alias("support_status"),
        F.array(F.when(F.col("l_discount") > 0.05, "verbatim").otherwise("near")).alias("tiers"),
    )
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(seg).alias("segments"))
    answers = nested.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", "segments")
    return M.traceability(answers, "o_orderpriority")


@query("SELECT vec_id FROM embeddings ORDER BY label = 3 DESC, sha256(CAST(vec_id AS VARCHAR) || 'seed') LIMIT 20")
def spot_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's twenty rows, some first, by seeded hash."""
    return M.seeded_sample(table(spark, sf_dir, "embeddings"), 20, "seed", "vec_id", F.col("label") == 3).select("vec_id")


@query(
    """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL"""
)
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour: batch twin of the streaming form."""
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


@query(
    """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a gap of six hours."""
    w = F.session_window("ts", "6 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 69")
def json_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on a JSON field."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(k == 69).select("event_id", k.alias("k"))


@query("SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY ALL")
def last_event_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
