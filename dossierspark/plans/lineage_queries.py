"""Clusters, facts and documents over time, on documents, events, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import supersession as S
from .registry import query, table

NORMAL = "sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"


def _copies(spark, sf):
    normal = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "))
    return table(spark, sf, "documents").withColumn("cluster_id", F.sha2(normal.cast("binary"), 256))


@query(f"SELECT cluster_id, min(doc_id) AS canonical_id, count(*) AS n FROM (SELECT doc_id, {NORMAL} AS cluster_id FROM documents) GROUP BY 1")
def exact_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of equal normal texts."""
    return _copies(spark, sf_dir).groupBy("cluster_id").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n"))


@query(
    f"""WITH c AS (SELECT doc_id, {NORMAL} AS cluster_id, lang = 'en' AS promoted, n_chars % 5 AS d FROM documents)
SELECT doc_id AS item_id, first_value(doc_id) OVER (PARTITION BY cluster_id ORDER BY promoted DESC, CASE WHEN d = 0 THEN NULL ELSE d END DESC NULLS LAST, doc_id) AS canonical_id FROM c"""
)
def canonical_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted first, newest date, oldest, id."""
    d = F.col("n_chars") % 5
    items = _copies(spark, sf_dir).select(
        F.col("doc_id").alias("item_id"),
        "cluster_id",
        (F.col("lang") == "en").alias("promoted"),
        F.when(d > 0, F.date_add(F.lit("2020-01-01").cast("date"), d.cast("int"))).alias("effective_date"),
        F.timestamp_seconds("doc_id").alias("created_at"),
    )
    return L.elect(items).select("item_id", "canonical_id")


#: Every vector and a near copy of it, whose id is 1,000,000 higher.
SHIFTED = """v AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  UNION ALL SELECT vec_id + 1000000, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i = 1 + vec_id % 5 THEN 0.02 * (1 + vec_id % 3) ELSE 0 END) FROM embeddings)"""


def _shifted(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    by = F.lit(0.02) * (1 + F.col("item_id") % 3)
    moved = F.transform("vector", lambda x, i: x + F.when(i == F.col("item_id") % 5, by).otherwise(0.0))
    return v.union(v.select(F.col("item_id") + 1_000_000, "grp", moved))


@query(f"WITH {SHIFTED} SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact similarity join within a label, over vectors and near copies of them."""
    return L.similar_pairs(_shifted(spark, sf_dir))


@query(
    f"""WITH {SHIFTED}, p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT id, least(id, coalesce((SELECT a FROM p WHERE b = id), id)) AS cluster FROM v)
SELECT id AS item_id, first_value(id) OVER (PARTITION BY cluster ORDER BY id % 7 = 0 DESC, id % 11 DESC, id % 1000, id) AS canonical_id FROM c"""
)
def leader_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: sequential clustering against current canonicals; here clusters are pairs at most, others are tested against a plain loop."""
    k = F.col("item_id")
    items = _shifted(spark, sf_dir).select(
        k,
        "grp",
        "vector",
        (k % 7 == 0).alias("promoted"),
        F.date_add(F.lit("2020-01-01").cast("date"), (k % 11).cast("int")).alias("effective_date"),
        F.timestamp_seconds(k % 1000).alias("created_at"),
    )
    return L.leader_clusters(items)


def _facts(spark, sf):
    """Events as dated facts: kind by event type, key by user (null for every seventh), document by event id."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("fact_id"),
        F.col("event_type").alias("kind"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("key"),
        (F.col("event_id") % 50).alias("document_id"),
        F.when(F.col("event_id") % 3 == 0, "reference").when(F.col("event_id") % 3 == 1, "past_submission").alias("doc_type"),
        (F.col("event_id") % 4 != 0).alias("confirmed"),
        F.when(F.col("event_id") % 5 == 0, "upload_time").otherwise("stated").alias("date_source"),
        F.to_date("ts").alias("effective_date"),
        F.to_date("ts").alias("document_date"),
        F.col("ts").alias("created_at"),
    )


FACTS = """f AS (
  SELECT event_id AS fact_id, event_type AS kind, CASE WHEN user_id % 7 <> 0 THEN user_id END AS key, event_id % 50 AS document_id,
    CASE event_id % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'past_submission' END AS doc_type, event_id % 4 <> 0 AS confirmed,
    CASE WHEN event_id % 5 = 0 THEN 'upload_time' ELSE 'stated' END AS date_source, CAST(ts AS DATE) AS effective_date, ts AS created_at FROM events)"""


@query(
    f"""WITH {FACTS} SELECT kind, key, fact_id FROM f QUALIFY row_number() OVER (PARTITION BY kind, key
  ORDER BY CASE WHEN doc_type = 'reference' THEN 0 ELSE 1 END, date_source = 'upload_time', effective_date DESC, fact_id) = 1"""
)
def current_fact_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    return L.current_facts(_facts(spark, sf_dir)).select("kind", "key", "fact_id")


@query(
    f"""WITH {FACTS}, g AS (SELECT * FROM f WHERE confirmed AND date_source <> 'upload_time' AND doc_type IS NOT NULL),
s AS (SELECT a.fact_id, max_by(b.fact_id, (b.effective_date, b.created_at, b.fact_id)) AS superseded_by FROM g a JOIN g b
  ON a.kind = b.kind AND a.key IS NOT DISTINCT FROM b.key AND a.doc_type = b.doc_type AND a.document_id <> b.document_id AND b.effective_date > a.effective_date GROUP BY 1)
SELECT f.fact_id, superseded_by FROM f LEFT JOIN s ON s.fact_id = f.fact_id"""
)
def successor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The successor of every fact."""
    return L.fact_successors(_facts(spark, sf_dir))


KINDS = "['iso_27001', 'dspt_confirmation', 'information_security_policy', 'other', 'cyber_essentials_plus']"


def _documents(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("iso_27001", "dspt_confirmation", "information_security_policy", "other", "cyber_essentials_plus")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    date = F.when(F.col("s_suppkey") % 9 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.abs(F.col("s_acctbal")) / 100).cast("int")))
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("document_id"),
        (F.col("s_nationkey") % 5).alias("org_id"),
        F.lit("reference").alias("doc_type"),
        kind.alias("doc_kind"),
        (F.col("s_suppkey") % 8 != 0).alias("confirmed"),
        date.alias("effective_date"),
        F.when(F.col("s_suppkey") % 6 == 0, "upload_time").otherwise("stated").alias("date_source"),
    )


DOCS = f"""d AS (
  SELECT s_suppkey AS document_id, s_nationkey % 5 AS org_id, {KINDS}[s_suppkey % 5 + 1] AS doc_kind, s_suppkey % 8 <> 0 AS confirmed,
    CASE WHEN s_suppkey % 9 > 0 THEN DATE '2020-01-01' + CAST(trunc(abs(s_acctbal) / 100) AS INTEGER) END AS effective_date,
    CASE WHEN s_suppkey % 6 = 0 THEN 'upload_time' ELSE 'stated' END AS date_source FROM supplier)"""


@query(
    f"""WITH {DOCS} SELECT a.document_id AS a_id, b.document_id AS b_id,
  CASE WHEN a.doc_kind = 'dspt_confirmation' THEN 'keyed_kind'
    WHEN a.date_source = 'upload_time' OR b.date_source = 'upload_time' OR a.effective_date IS NULL OR b.effective_date IS NULL THEN 'pending_date'
    WHEN a.effective_date = b.effective_date THEN 'tie' ELSE 'auto' END AS reason
FROM d a JOIN d b ON a.org_id = b.org_id AND a.doc_kind = b.doc_kind AND a.document_id < b.document_id
WHERE a.doc_kind <> 'other' AND a.confirmed AND b.confirmed"""
)
def pair_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every pair of supersedable documents of one kind."""
    d = _documents(spark, sf_dir).where("confirmed and doc_kind <> 'other'")
    a = d.select("org_id", "doc_kind", F.col("document_id").alias("a_id"), F.col("effective_date").alias("a_date"), F.col("date_source").alias("a_source"))
    b = d.select("org_id", "doc_kind", F.col("document_id").alias("b_id"), F.col("effective_date").alias("b_date"), F.col("date_source").alias("b_source"))
    both = a.join(b, ["org_id", "doc_kind"]).where("a_id < b_id")
    return both.select("a_id", "b_id", L.pair_outcome(*[F.col(c) for c in ("doc_kind", "a_date", "b_date", "a_source", "b_source")])["reason"].alias("reason"))


@query(
    f"""WITH {DOCS}, g AS (SELECT * FROM d WHERE confirmed AND doc_kind NOT IN ('other', 'dspt_confirmation') AND effective_date IS NOT NULL AND date_source <> 'upload_time'),
s AS (SELECT a.document_id, max_by(b.document_id, (b.effective_date, b.document_id)) AS superseded_by FROM g a JOIN g b
  ON a.org_id = b.org_id AND a.doc_kind = b.doc_kind AND b.effective_date > a.effective_date GROUP BY 1)
SELECT d.document_id, superseded_by FROM d LEFT JOIN s ON s.document_id = d.document_id"""
)
def document_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest superseder of every document."""
    return L.document_supersession(_documents(spark, sf_dir))


@query("SELECT event_id AS fact_id FROM events WHERE CAST(ts AS DATE) + CAST(value AS INTEGER) < DATE '2024-02-01' AND event_type <> 'error'")
def expiry_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 for a fixed day."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"),
        F.date_add(F.to_date("ts"), F.rint("value").cast("int")).alias("expires_on"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("expired_at"),
    )
    return L.expired(e, F.lit("2024-02-01").cast("date")).select("fact_id")


#: Orders as documents of five kinds (by number, as in KINDS) with their lines as items and facts, and decisions about neighbours and about each group's latest.
ORDER_DOCS = """d AS (
  SELECT o_orderkey AS id, o_orderkey // 2000 AS org, o_orderkey % 5 AS kind, o_orderkey % 8 <> 0 AS confirmed,
    CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 6 = 0 AS uploaded,
    CASE WHEN o_orderkey % 13 = 0 THEN TIMESTAMP '2024-06-20' END AS moved_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 5 END AS previous FROM orders
), latest AS (SELECT org, kind, max_by(id, (day, id)) AS latest_id FROM d WHERE day IS NOT NULL GROUP BY ALL),
told AS (
  SELECT id AS a, id + 5 AS b, CASE WHEN id % 11 = 0 THEN -1 ELSE kind END AS kind,
    CASE id // 7 % 4 WHEN 1 THEN id WHEN 2 THEN id + 5 END AS newer, TIMESTAMP '2024-06-01' + to_days(CAST(id % 50 AS INTEGER)) AS at_
  FROM d WHERE id % 7 = 0
  UNION ALL SELECT id, latest_id, d.kind, NULL, TIMESTAMP '2024-07-30' FROM d JOIN latest USING (org, kind) WHERE id % 17 = 0 AND id <> latest_id
), able AS (SELECT * FROM d WHERE kind <> 3 AND confirmed),
last AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY at_ DESC, newer DESC NULLS LAST) = 1),
states AS (
  SELECT last.*, CASE WHEN x.id IS NULL OR y.id IS NULL OR x.org <> y.org OR x.kind <> last.kind OR y.kind <> last.kind THEN 2
    WHEN x.moved_at > at_ OR y.moved_at > at_ THEN 1 ELSE 0 END AS state
  FROM last LEFT JOIN able x ON x.id = a LEFT JOIN able y ON y.id = b
), stands AS (SELECT a, b, newer FROM states WHERE state = 0),
both_ways AS (SELECT a AS id, b AS other FROM stands UNION ALL SELECT b, a FROM stands),
by_hand AS (
  SELECT CASE WHEN newer = a THEN b ELSE a END AS id, max_by(newer, (coalesce(d.day, DATE '0001-01-01'), newer)) AS by_
  FROM stands JOIN d ON d.id = newer WHERE newer IS NOT NULL GROUP BY 1
), rounds AS (
  SELECT id, org * 5 + id % 5 AS grp, day, 0 AS state, CAST(NULL AS BIGINT) AS by_, 0 AS n FROM able
  WHERE day IS NOT NULL AND NOT uploaded AND kind <> 1 AND id NOT IN (SELECT id FROM by_hand)
  UNION ALL
  SELECT t.id, t.grp, t.day, CASE WHEN t.day = top THEN 1 WHEN by_now IS NULL THEN 0 ELSE 2 END, by_now, n + 1
  FROM (SELECT *, max(day) OVER (PARTITION BY grp) AS top FROM rounds WHERE state = 0) t
  LEFT JOIN LATERAL (
    SELECT max(l.id) AS by_now FROM (SELECT *, max(day) OVER (PARTITION BY grp) AS top FROM rounds WHERE state = 0) l
    WHERE l.grp = t.grp AND l.day = l.top AND t.day < l.top AND NOT EXISTS (SELECT 1 FROM both_ways w WHERE w.id = t.id AND w.other = l.id)
  ) ON true
), pointers AS (SELECT id, by_ FROM by_hand UNION ALL SELECT id, by_ FROM rounds WHERE state = 2),
moved AS (
  SELECT d.id, d.previous, p.by_, CASE WHEN previous IS NULL AND by_ IS NOT NULL THEN 'document_superseded' WHEN previous IS NOT NULL AND by_ IS NULL THEN 'supersession_reversed' END AS event,
    s.state
  FROM d LEFT JOIN pointers p ON p.id = d.id LEFT JOIN states s ON (s.a = d.id AND s.b = d.previous) OR (s.b = d.id AND s.a = d.previous)
), lines AS (
  SELECT l_orderkey AS id, count(*) FILTER (l_linenumber % 2 = 0) AS n_hidden, count(*) FILTER (l_linenumber % 2 = 1) AS n_shown, count(*) FILTER (l_returnflag <> 'R') AS n_current
  FROM lineitem GROUP BY 1
)"""


@query(
    f"""WITH RECURSIVE {ORDER_DOCS}
SELECT id AS document_id, event, by_ AS superseded_by, previous,
  CASE WHEN event = 'supersession_reversed' THEN CASE state WHEN 0 THEN 'keep_both' WHEN 1 THEN 'date_changed' WHEN 2 THEN 'decision_removed' ELSE 're_evaluated' END END AS reason,
  coalesce(CASE WHEN event = 'supersession_reversed' THEN n_hidden ELSE n_shown END, 0) AS n_items,
  CASE WHEN event = 'document_superseded' THEN coalesce(n_current, 0) ELSE 0 END AS n_facts
FROM moved LEFT JOIN lines USING (id) WHERE event IS NOT NULL"""
)
def supersession_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decisions, changed dates and new documents supersede and reverse, with the items and facts this touches."""
    kinds = F.array(*[F.lit(k) for k in ("iso_27001", "dspt_confirmation", "information_security_policy", "other", "cyber_essentials_plus")])
    key = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(
        key.alias("document_id"),
        F.floor(key / 2000).alias("org_id"),
        F.lit("reference").alias("doc_type"),
        F.element_at(kinds, (key % 5 + 1).cast("int")).alias("doc_kind"),
        (key % 8 != 0).alias("confirmed"),
        F.when(key % 9 > 0, F.to_date("o_orderdate")).alias("effective_date"),
        F.when(key % 6 == 0, "upload_time").otherwise("stated").alias("date_source"),
        F.when(key % 13 == 0, F.lit("2024-06-20").cast("timestamp")).alias("date_changed_at"),
        F.when(key % 3 == 0, key + 5).alias("superseded_by"),
    )
    k = F.col("document_id")
    way = F.floor(k / 7) % 4
    beside = docs.where("document_id % 7 = 0").select(
        k.alias("a_id"),
        (k + 5).alias("b_id"),
        F.when(k % 11 == 0, "iso").otherwise(F.col("doc_kind")).alias("doc_kind"),
        F.when(way == 1, k).when(way == 2, k + 5).alias("newer_id"),
        F.timestamp_add("DAY", (k % 50).cast("int"), F.lit("2024-06-01").cast("timestamp")).alias("decided_at"),
    )
    latest = docs.where("effective_date is not null").groupBy("org_id", "doc_kind").agg(F.max_by("document_id", F.struct("effective_date", "document_id")).alias("b_id"))
    kept = docs.where("document_id % 17 = 0").join(latest, ["org_id", "doc_kind"]).where("document_id <> b_id")
    kept = kept.select(k.alias("a_id"), "b_id", "doc_kind", F.lit(None).cast("long").alias("newer_id"), F.lit("2024-07-30").cast("timestamp").alias("decided_at"))
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select(line.alias("item_id"), F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2 == 0).alias("excluded"))
    facts = lines.select(line.alias("fact_id"), F.col("l_orderkey").alias("document_id"), (F.col("l_returnflag") != "R").alias("current"))
    return S.supersede(docs, beside.union(kept), items, facts).events
