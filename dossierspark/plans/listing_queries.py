"""Lists, filters, orders, tasks and exports, over orders, customers, suppliers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import listing as L
from .registry import query, table


def _pick(c, *values):
    """One of fixed values (None for null) by c modulo their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(c % len(values) == i, v).otherwise(out)
    return out


STATUS = ("not_started", "ai_draft", "writer_edited", "sme_verified", "approved")
STATUS_SQL = "['not_started', 'ai_draft', 'writer_edited', 'sme_verified', 'approved'][o_orderkey % 5 + 1]"


def _questions(spark, sf):
    """Orders as questions of a customer."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("question_id"),
        F.col("o_custkey").alias("pack_id"),
        F.col("o_orderpriority").alias("section"),
        k.alias("order_index"),
        _pick(k, *STATUS).alias("status"),
        _pick(k, "unknown", "covered", "partial", "new", None, "odd").alias("coverage"),
        F.when(k % 3 > 0, k % 11).alias("weighting"),
        _pick(k, "Ann", None, "bob", "", "Cleo").alias("assignee"),
        F.when(k % 4 > 0, (k % 9) / 8).alias("support_score"),
        F.when(k % 6 > 0, k % 300).alias("word_count"),
        F.when(k % 7 > 0, k % 250).alias("word_limit"),
        (k % 10 == 0).alias("needs_review"),
    )


Q = f"""q AS (SELECT o_orderkey AS question_id, o_custkey AS pack_id, o_orderpriority AS section, o_orderkey AS order_index, {STATUS_SQL} AS status,
  ['unknown', 'covered', 'partial', 'new', NULL, 'odd'][o_orderkey % 6 + 1] AS coverage, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 11 END AS weighting,
  ['Ann', NULL, 'bob', '', 'Cleo'][o_orderkey % 5 + 1] AS assignee, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 9) / 8 END AS support_score,
  CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 300 END AS word_count, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 250 END AS word_limit, o_orderkey % 10 = 0 AS needs_review FROM orders)"""


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0")
def eligible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what retrieval may rank."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") != "P").alias("text_verified"), (F.col("o_orderkey") % 7 == 0).alias("excluded")
    )
    return L.eligible(items).select("item_id")


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 15")
def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the library, newest first."""
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("item_type"), F.col("o_custkey").alias("document_id"),
        (F.col("o_orderkey") % 2 == 0).alias("text_verified"), F.lit(True).alias("is_canonical"), F.col("o_orderdate").alias("created_at"),
    )
    return L.library_page(items, item_type="F", verified=True, canonical_only=True, offset=15, size=40).select("item_id")


@query("WITH p AS (SELECT o_orderkey AS fact_id, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60 OFFSET 20) SELECT fact_id FROM p WHERE o_orderstatus <> 'F'")
def fact_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the page is cut before current facts are kept, so it may be short."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), "o_orderstatus", F.col("o_orderdate").alias("created_at"))
    return L.fact_page(facts, F.col("o_orderstatus") != "F", True, 20, 60).select("fact_id")


def _requirements(spark, sf):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        k.alias("requirement_id"), F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("order_index"), _pick(k, "A", "B", "C", None).alias("compliance_class"),
        _pick(F.col("l_partkey"), "must", "should", "could", None, "odd").alias("priority"), _pick(F.col("l_suppkey"), "Ann", None, "bob").alias("owner"),
        F.col("l_returnflag").alias("ref"), F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("text"), F.lit(None).cast("string").alias("comment"), F.col("l_linestatus").alias("document"),
    )


R = """r AS (SELECT l_orderkey * 10 + l_linenumber AS requirement_id, l_orderkey AS pack_id, l_partkey AS order_index, ['A', 'B', 'C', NULL][(l_orderkey * 10 + l_linenumber) % 4 + 1] AS compliance_class,
  ['must', 'should', 'could', NULL, 'odd'][l_partkey % 5 + 1] AS priority, ['Ann', NULL, 'bob'][l_suppkey % 3 + 1] AS owner, 'Item ' || l_partkey AS text FROM lineitem)"""


@query(f"WITH {R} SELECT requirement_id, order_index FROM r WHERE (compliance_class = 'C' OR (compliance_class IS NULL AND priority = 'must')) AND contains(lower(text), 'item 1')")
def attention_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """red or unrated musts that a search finds."""
    return L.filter_requirements(_requirements(spark, sf_dir), search=" Item 1", attention=True).select("requirement_id", "order_index")


RATING = "CASE compliance_class WHEN 'C' THEN 0 WHEN 'B' THEN 2 WHEN 'A' THEN 3 ELSE 1 END"


@query(
    f"""WITH {R}, s AS (SELECT *, {RATING} AS rating_key, CASE priority WHEN 'must' THEN 0 WHEN 'should' THEN 1 WHEN 'could' THEN 2 END AS priority_key FROM r)
SELECT 'rating' AS key, pack_id, order_index, rank() OVER (PARTITION BY pack_id ORDER BY rating_key DESC NULLS LAST, order_index) AS place FROM s
UNION ALL SELECT 'priority', pack_id, order_index, rank() OVER (PARTITION BY pack_id ORDER BY priority_key NULLS LAST, order_index) FROM s
UNION ALL SELECT 'owner', pack_id, order_index, rank() OVER (PARTITION BY pack_id ORDER BY lower(owner) DESC NULLS LAST, order_index) FROM s"""
)
def requirement_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: requirements by rating, priority and owner; missing ones last either way."""
    rows, parts = _requirements(spark, sf_dir), []
    for key, down in (("rating", True), ("priority", False), ("owner", True)):
        w = Window.partitionBy("pack_id").orderBy(*L.sorted_by(L.requirement_key_of(key), down))
        parts.append(rows.select(F.lit(key).alias("key"), "pack_id", "order_index", F.rank().over(w).cast("long").alias("place")))
    return parts[0].union(parts[1]).union(parts[2])


SORTS = {
    "order": "order_index", "weighting": "weighting", "coverage": "list_position(['unknown', 'covered', 'partial', 'new'], coverage)", "assignee": "lower(nullif(assignee, ''))",
    "status": "list_position(['not_started', 'ai_draft', 'writer_edited', 'sme_verified', 'approved'], status)", "support": "support_score", "words": "coalesce(word_count, 0) / nullif(word_limit, 0)",
}
KEYED = {k: f"CASE WHEN ({v}) = 0 THEN NULL ELSE ({v}) END" if "list_position" in v else v for k, v in SORTS.items()}


@query(
    f"WITH {Q} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS key, {str(d).lower()} AS descending, question_id, row_number() OVER (PARTITION BY pack_id ORDER BY {v} {'DESC' if d else 'ASC'} NULLS LAST, order_index) AS place FROM q"
        for k, v in KEYED.items()
        for d in (False, True)
    )
)
def question_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: questions by each of seven columns, both ways."""
    rows, out = _questions(spark, sf_dir), None
    for key in SORTS:
        for down in (False, True):
            w = Window.partitionBy("pack_id").orderBy(*L.sorted_by(L.question_key_of(key), down))
            part = rows.select(F.lit(key).alias("key"), F.lit(down).alias("descending"), "question_id", F.row_number().over(w).cast("long").alias("place"))
            out = part if out is None else out.union(part)
    return out


@query(f"WITH {Q} SELECT section, min(order_index) AS first FROM q GROUP BY 1")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in the buyer's order."""
    return L.sections_in_order(_questions(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN n_chars % 50 < doc_id % 90 AND doc_id % 90 <= length(text) THEN substr(text, CAST(n_chars % 50 + 1 AS BIGINT), CAST(doc_id % 90 - n_chars % 50 AS BIGINT)) END AS marked FROM documents")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the marked part of each text, null where the span is no valid one."""
    return table(spark, sf_dir, "documents").select("doc_id", L.highlight(F.col("text"), (F.col("n_chars") % 50).cast("int"), (F.col("doc_id") % 90).cast("int")).alias("marked"))


@query(
    """WITH near AS (SELECT s_nationkey AS query_id, s_suppkey % 40 AS section_id, min(s_suppkey % 7) AS rank FROM supplier GROUP BY ALL)
SELECT query_id, event_id AS fact_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, CAST(ts AS DATE) DESC NULLS LAST, event_id) AS place
FROM near JOIN events ON user_id = section_id"""
)
def attached_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of ranked items' sections."""
    items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), (F.col("s_suppkey") % 40).alias("section_id"), (F.col("s_suppkey") % 7).alias("rank"))
    facts = table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("section_id"), F.to_date("ts").alias("effective_date"))
    return L.attached_facts(items, facts).select("query_id", "fact_id", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey AS requirement_id, c_name AS filename, n_name AS heading FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3")
def requirement_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with document and section."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_custkey").alias("document_id"))
    customers = table(spark, sf_dir, "customer")
    sections = customers.join(table(spark, sf_dir, "nation").where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = customers.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"), F.col("c_nationkey").alias("section_id"))
    heads = sections.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("section_id"), F.col("n_name").alias("heading"))
    return L.requirement_sources(rows, docs, heads).select("requirement_id", "filename", "heading")


@query("SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS part, s_name AS filename FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its document."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("document_id"))
    docs = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("filename"))
    return L.evidence_documents(rows, docs).select("evidence_id", "part", "filename")


@query("SELECT o_orderkey AS item_id, c_name AS filename FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def items_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup of documents, unknown ones null."""
    docs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    return L.with_documents(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("document_id")), docs, "filename").select("item_id", "filename")


@query("SELECT c_custkey AS thread_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def visible_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with a visible message."""
    messages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thread_id"), (F.col("o_orderstatus") != "F").alias("hidden"))
    return L.with_visible_messages(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread_id")), messages)


@query(
    """SELECT o_orderkey AS question_id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey
JOIN (SELECT c_custkey AS u, c_nationkey % 3 AS w FROM customer WHERE c_acctbal > 500) ON u = o_custkey AND w = o_orderkey % 3"""
)
def active_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers with profile and active membership."""
    customers = table(spark, sf_dir, "customer")
    reviewers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 3).cast("int").alias("workspace_id"))
    profiles = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    members = customers.select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 3).alias("workspace_id"), F.when(F.col("c_acctbal") > 500, "active").otherwise("left").alias("status"))
    return L.active_reviewers(reviewers, profiles, members).select("question_id", "name")


@query(
    """WITH m AS (SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS said FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1)
SELECT c_custkey AS thread_id, s_name AS resolver, said FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 70 AND c_custkey % 2 = 0 LEFT JOIN m ON conv_id = c_custkey"""
)
def threads_with_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with resolver and nested messages."""
    threads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 70).alias("resolved_by"))
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"), F.col("role").alias("body")).distinct()
    profiles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    said = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["position"].cast("string"), m["body"])), ",")
    return L.threads_with_messages(threads, messages, profiles).select("thread_id", "resolver", said.alias("said"))


@query(
    f"""WITH {Q}, w AS (SELECT *, question_id % 4 AS attention, question_id % 2 AS n_sme, question_id % 3 AS n_app FROM q)
SELECT question_id, CASE WHEN status = 'not_started' OR needs_review THEN 'owner' WHEN status IN ('ai_draft', 'writer_edited') AND n_sme > 0 THEN 'sme'
  WHEN status = 'ai_draft' OR (status = 'writer_edited' AND attention > 0) THEN 'owner' WHEN status IN ('writer_edited', 'sme_verified') AND n_app > 0 THEN 'approver' ELSE 'owner' END AS who,
  CASE WHEN status = 'not_started' THEN 'Write or generate the answer' WHEN needs_review THEN 'Resolve the items marked as needing review'
    WHEN status IN ('ai_draft', 'writer_edited') AND n_sme > 0 THEN 'Verify the answer as SME reviewer' WHEN status = 'ai_draft' THEN 'Review and edit the AI draft'
    WHEN status = 'writer_edited' AND attention > 0 THEN attention || CASE WHEN attention = 1 THEN ' sentence needs' ELSE ' sentences need' END || ' a source or confirmation'
    WHEN status IN ('writer_edited', 'sme_verified') AND n_app > 0 THEN 'Approve the answer' WHEN status = 'writer_edited' THEN 'Move the answer on for approval'
    WHEN status = 'sme_verified' THEN 'Approve the answer' ELSE 'Approved' END AS reason FROM w"""
)
def waiting_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each question waits for, and why."""
    k = F.col("question_id")
    w = L.waiting_on(F.col("status"), F.col("needs_review"), k % 4, k % 2, k % 3)
    return _questions(spark, sf_dir).select("question_id", w.alias("w")).select("question_id", "w.who", "w.reason")


@query(
    """SELECT event_id, CAST(date_diff('day', DATE '2024-01-15', CAST(ts AS DATE)) AS INTEGER) AS remaining,
  CAST(ceil(epoch_us(ts - TIMESTAMP '2024-01-15 10:30:00') / 86400000000.0) AS BIGINT) AS until FROM events"""
)
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by date and by the clock."""
    now = F.lit("2024-01-15 10:30:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", L.days_remaining(F.col("ts"), F.lit("2024-01-15").cast("date")).alias("remaining"), L.days_until(F.col("ts").cast("timestamp"), now).alias("until"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS unread, count(*) AS total FROM events GROUP BY 1")
def unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return L.unread_counts(table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("read_at")))


@query("SELECT event_type AS name, count(*) AS calls FROM events GROUP BY 1")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return L.call_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"))


@query(
    """SELECT count(*) AS documents, count(*) FILTER (s_acctbal >= 0) AS ready, count(*) FILTER (s_acctbal < 0) AS failed,
  (SELECT count(*) FROM events) AS facts, (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS superseded FROM supplier"""
)
def ingestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    docs = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") >= 0, "ready").otherwise("failed").alias("ingest_status"))
    return L.ingestion_counts(docs, table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, 1).alias("superseded_by")))


@query(
    f"""WITH {Q} SELECT question_id, section, CAST(order_index AS VARCHAR) AS number, 'Question ' || question_id AS question, coalesce(assignee, '[No approved answer]') AS answer,
  CASE WHEN question_id % 5 = 4 THEN 'Approved' ELSE ['Not started', 'AI draft', 'Writer edited', 'SME verified'][question_id % 5 + 1] END AS status, CASE WHEN assignee IS NOT NULL THEN word_count END AS words FROM q"""
)
def sheet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the six columns of a sheet, with status labels and word counts."""
    rows = _questions(spark, sf_dir).select(
        "section", F.col("order_index").cast("string").alias("number"), F.concat(F.lit("Question "), F.col("question_id").cast("string")).alias("text"), F.col("assignee").alias("answer_text"), "status", "word_count"
    )
    return L.export_values(rows, "[No approved answer]").withColumn("question_id", F.col("number").cast("long"))


@query(
    """WITH t AS (SELECT s_suppkey, [NULL, '', ' [Your answer] ', 'Bidder to complete', '....', s_name][s_suppkey % 6 + 1] AS existing, s_suppkey % 5 = 0 AS formula, repeat(s_name, 2000) AS text FROM supplier),
r AS (SELECT *, CASE WHEN existing IS NULL THEN 'missing' WHEN formula THEN 'formula' WHEN s_suppkey % 6 = 5 THEN 'occupied: ' || substr(existing, 1, 60) END AS reason FROM t)
SELECT s_suppkey AS label, reason, CASE WHEN reason IS NULL THEN substr(text, 1, 32767) END AS fill FROM r"""
)
def form_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: which cells of a form are filled, with what, and why others are not."""
    k = F.col("s_suppkey")
    existing = F.when(k % 6 == 5, F.col("s_name")).otherwise(_pick(k, None, "", " [Your answer] ", "Bidder to complete", "....", None))
    targets = table(spark, sf_dir, "supplier").select(k.alias("label"), existing.alias("existing"), (k % 5 == 0).alias("formula"), F.repeat("s_name", 2000).alias("text"))
    return L.form_fills(targets).select("label", "reason", "fill")


@query(
    """WITH s AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS position, turn // 3 AS paragraph, lag(turn // 3) OVER w AS before FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id AS answer_id, CAST(position AS INTEGER) AS position, paragraph, role AS text, coalesce(before <> paragraph, true) AS opens, CASE WHEN role = 'assistant' THEN 'said in turn ' || turn END AS comment FROM s"""
)
def commented_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: sentences with where their paragraph opens and the comment on their sources."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    seg = F.struct("turn", F.col("role").alias("text"), F.expr("turn div 3").alias("paragraph"))
    answers = turns.groupBy(F.col("conv_id").alias("answer_id")).agg(F.sort_array(F.collect_list(seg)).alias("segments"))
    return L.paragraphs_with_comments(answers, lambda s: F.when(s["text"] == "assistant", F.concat(F.lit("said in turn "), s["turn"].cast("string"))))


@query("SELECT event_type AS section, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS place, format('| user {} | {:.4f} |', user_id, count(*) / 4) AS line FROM events GROUP BY event_type, user_id")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: lines of a report's tables."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("section"), "user_id").agg((F.count("*") / 4).alias("value"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("user_id")).cast("long")
    return L.report_lines(rows.select("section", place.alias("place"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), "value"))
