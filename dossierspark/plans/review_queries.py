"""Aggregates, board lists, exports and orderings, over orders as packs and line items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import merging, review
from .registry import query, table


def _questions(spark, sf):
    """Line items as questions of an order: status and class by return flag, line status and number."""
    status = F.when(F.col("l_returnflag") == "R", "approved").when(F.col("l_returnflag") == "A", "ai_draft").otherwise("not_started")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("pack_id"),
        F.col("l_linenumber").alias("number"),
        status.alias("status"),
        F.col("l_quantity").cast("long").alias("word_limit"),
        F.col("l_partkey").alias("words"),
        F.when(F.col("l_linestatus") == "F", "C").alias("class"),
        (F.col("l_discount") > 0.05).alias("mandatory"),
        (F.col("l_tax") > 0.05).alias("needs_review"),
        "l_suppkey",
    )


@query(
    """SELECT o_orderkey AS pack_id, count(l_orderkey) AS n_questions, count(*) FILTER (l_returnflag = 'R') AS n_approved,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS word_limit,
  CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_partkey END), 0) AS BIGINT) AS approved_words,
  count(*) FILTER (l_linestatus = 'F') AS n_class_c, count(*) FILTER (l_discount > 0.05 AND l_linestatus <> 'F') AS n_mandatory_unclassified,
  count(*) FILTER (l_tax > 0.05) AS n_needs_review
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def pack_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J3."""
    return review.pack_aggregates(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id")), _questions(spark, sf_dir))


@query(
    """SELECT l_orderkey AS pack_id, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS green, count(*) FILTER (l_returnflag = 'R') AS amber,
  0::BIGINT AS red, count(*) FILTER (l_returnflag = 'N') AS unrated, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS suggested_unrated
FROM lineitem GROUP BY 1"""
)
def requirement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    rating = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pack_id"), rating.alias("rating"), F.when(F.col("l_linestatus") == "O", "A").alias("suggestion")
    )
    return review.requirement_summary(rows)


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def count_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return review.count_pivot(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["O", "F", "P"])


@query(
    """WITH answers AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS answer_id, max(o_orderdate) AS at FROM orders GROUP BY 1)
SELECT c_custkey AS question_id, answer_id, n_name AS thread_id FROM customer LEFT JOIN answers ON o_custkey = c_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1"""
)
def board_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their current (latest) order and a thread, if any."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "question_id", "o_orderkey": "answer_id"})
    latest = orders.groupBy("question_id").agg(F.max_by("answer_id", F.struct("o_orderdate", "answer_id")).alias("answer_id"))
    answers = latest.select("question_id", "answer_id", F.lit(1).alias("version"), F.lit(True).alias("is_current"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("thread_id"))
    threads = customers.join(nations, "c_nationkey").select("question_id", "thread_id")
    return review.board_list(customers.select("question_id"), answers, threads).select("question_id", "answer_id", "thread_id")


@query(
    """SELECT o_orderkey AS question_id, o_orderpriority AS section, CASE WHEN o_orderstatus = 'F' THEN c_name ELSE '[No approved answer]' END AS shown
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: export rows, answers shown where approved."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("ai_draft")
    questions = orders.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("section"), status.alias("status"), F.lit(False).alias("needs_review"))
    answers = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("question_id"), F.col("c_name").alias("answer_text"), F.lit(True).alias("is_current")
    )
    return review.export_rows(questions, answers, "submission").select("question_id", "section", "shown")


@query(
    """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal >= 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS INTEGER) AS place
FROM customer"""
)
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: nulls last while descending, by nation."""
    key = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    w = Window.partitionBy("c_nationkey").orderBy(review.nulls_last(key, True), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).alias("place"))


@query(
    """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST,
  CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END DESC, o_orderkey) AS INTEGER) AS place FROM orders"""
)
def urgency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadline (null last), weight, index, by customer."""
    weight = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1)
    order = review.urgency(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), weight, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("place"))


def _segments(spark, sf):
    """Line items nested by order as segments of an answer."""
    kind = F.when(F.col("l_linestatus") == "O", "substantive").otherwise("connective")
    status = F.when(F.col("l_returnflag") == "R", "supported").when(F.col("l_returnflag") == "A", "weak").otherwise("unsupported")
    seg = F.struct(
        F.col("l_linenumber").alias("index"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        kind.alias("kind"),
        status.alias("support_status"),
        F.array(F.col("l_suppkey").cast("string")).alias("sources"),
    )
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.sort_array(F.collect_list(seg)).alias("segments"))


@query(
    """SELECT l_orderkey AS answer_id, count(*) FILTER (l_linestatus = 'O') AS substantive, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS supported,
  count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'R') AS needs_attention,
  count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') / nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS score FROM lineitem GROUP BY 1"""
)
def nested_support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of nested segments."""
    s = _segments(spark, sf_dir).select("answer_id", review.support_summary(F.col("segments")).alias("s"))
    big = lambda c: F.col(f"s.{c}").cast("long").alias(c)
    return s.select("answer_id", big("substantive"), big("supported"), big("needs_attention"), F.col("s.score").alias("score"))


@query(
    """WITH stale AS (SELECT CAST(s_suppkey AS VARCHAR) AS source_id FROM supplier WHERE s_acctbal < 0)
SELECT l_orderkey AS answer_id, count(*) AS n_changed FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'A'
  AND CAST(l_suppkey AS VARCHAR) IN (SELECT source_id FROM stale) GROUP BY 1"""
)
def invalidated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a stale source."""
    from ..operators.verification import invalidation_effects

    none = F.expr("cast(array() as array<struct<fact_id:string,status:string>>)")
    answers = _segments(spark, sf_dir).withColumn("question_id", F.col("answer_id")).withColumn("needs_review", F.lit(False)).withColumn("checklist", none)
    stale = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("source_id"), F.lit("removed").alias("reason"))
    return invalidation_effects(answers, stale).select("answer_id", F.size("changed").cast("long").alias("n_changed"))


@query(
    """WITH q AS (SELECT l_orderkey AS question_id, count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'R') AS open, bool_or(l_tax > 0.07) AS flagged FROM lineitem GROUP BY 1)
SELECT question_id, t.to, CASE t.to WHEN 'not_started' THEN false WHEN 'ai_draft' THEN false WHEN 'writer_edited' THEN true ELSE open = 0 AND NOT flagged END AS allowed,
  CAST(CASE t.to WHEN 'not_started' THEN 1 WHEN 'ai_draft' THEN 1 WHEN 'writer_edited' THEN 0 ELSE open + CASE WHEN flagged THEN 1 ELSE 0 END END AS INTEGER) AS n_blockers
FROM q, (SELECT unnest(['not_started', 'ai_draft', 'writer_edited', 'sme_verified', 'approved']) AS "to") t"""
)
def transition_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each status asks of every answer."""
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.bool_or(F.col("l_tax") > 0.07).alias("needs_review"))
    none = F.array().cast("array<string>")
    q = _segments(spark, sf_dir).join(flags, "answer_id").select(
        F.col("answer_id").alias("question_id"), F.lit(True).alias("has_answer"), "segments", "needs_review", none.alias("gaps"), none.alias("acknowledged")
    )
    return review.allowed_transitions(q).select("question_id", "to", "allowed", F.size("blockers").alias("n_blockers"))


@query(
    """WITH spoken AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS begun FROM conversations WHERE role <> 'system'),
marked AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM spoken WHERE begun = 1),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked)
SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM runs GROUP BY conv_id, run"""
)
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11."""
    return review.merged_turns(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role, max_by(text, turn) AS text FROM conversations GROUP BY 1")
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return review.last_message(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    """SELECT coalesce(o.k, n.k) AS o_orderkey, CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price, coalesce(o.who, n.who) AS who,
  CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'kept' ELSE 'updated' END AS state
FROM (SELECT o_orderkey AS k, o_totalprice AS price, o_custkey AS who FROM orders WHERE o_orderstatus <> 'P') o
FULL JOIN (SELECT o_orderkey AS k, o_totalprice * 2 AS price, -1::BIGINT AS who FROM orders WHERE o_orderstatus <> 'F') n ON o.k = n.k"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted columns follow the new row, others stay."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("who"))
    new = orders.where("o_orderstatus <> 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"), F.lit(-1).cast("long").alias("who"))
    return merging.upsert(old, new, ["o_orderkey"], ["price"])


@query(
    """SELECT o_orderkey, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference both ways."""
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merging.missing_and_unexpected(table(spark, sf_dir, "orders"), found, ["o_orderkey"])


SPANS = """
a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS section_id, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_quantity AS BIGINT) AS e, l_returnflag AS f, l_partkey, l_quantity FROM lineitem),
pick AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, section_id, s, e) AS n FROM a)"""


@query(
    f"""WITH {SPANS}, j AS (
  SELECT x.id AS a_id, y.id AS b_id, greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s)) AS share
  FROM pick x JOIN pick y ON x.section_id = y.section_id AND x.f = 'R' AND y.f = 'A' AND x.n = 1 AND y.n = 1
  WHERE greatest(x.e, y.e) > least(x.s, y.s))
SELECT a_id, max_by(b_id, (share, -b_id)) AS b_id, max(share) AS share FROM j WHERE share >= 0.6 GROUP BY a_id"""
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best overlapping span of the same section."""
    s = F.col("l_partkey").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("section_id"),
        s.alias("start"),
        (s + F.col("l_quantity").cast("long")).alias("end"),
        F.col("l_returnflag").alias("f"),
    )
    rows = rows.groupBy("id").agg(F.min(F.struct("f", "section_id", "start", "end")).alias("m")).select("id", "m.*")
    return merging.overlap_join(rows.where("f = 'R'").drop("f"), rows.where("f = 'A'").drop("f"))


@query(
    """SELECT o_orderkey, CASE WHEN n > 1 THEN o_orderpriority || ' (' || n || ')' ELSE o_orderpriority END AS number
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)"""
)
def unique_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated numbers of a section get a suffix."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("number"))
    return merging.unique_numbers(rows, ["o_custkey"], "number", F.col("o_orderkey")).select("o_orderkey", "number")


@query(
    """SELECT key, count(p_partkey) AS n, place FROM (SELECT unnest(['ECONOMY', 'PROMO', 'STANDARD', 'NONE SUCH']) AS key, unnest([0, 1, 2, 3])::INTEGER AS place)
LEFT JOIN part ON p_type = key GROUP BY key, place"""
)
def grouped_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty groups kept."""
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_type", "key")
    return review.grouped_with_empty(rows, ["ECONOMY", "PROMO", "STANDARD", "NONE SUCH"], "key")
