"""Versions, actions, promotion, verification and resolution, over orders, line items, suppliers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import verification as V
from ..operators.components import written
from .listing_queries import STATUS, STATUS_SQL, _pick
from .registry import query, table


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _versions(spark, sf):
    """Orders as versions of a customer's answer, in order of date; every fifth customer has no current one."""
    o = _orders(spark, sf)
    per = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("v"))
    rows = per.select(F.col("o_custkey").alias("question_id"), F.size("v").alias("n"), F.posexplode("v").alias("i", "r"))
    return rows.select(
        "question_id", F.col("r.o_orderkey").alias("answer_id"), (F.col("i") + 1).alias("version"), ((F.col("i") + 1 == F.col("n")) & (F.col("question_id") % 5 > 0)).alias("is_current")
    )


VERSIONS = """v AS (SELECT o_custkey AS question_id, o_orderkey AS answer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AND o_custkey % 5 > 0 AS is_current FROM orders)"""


def _customers(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("question_id"), _pick(k, *STATUS).alias("status"), (k % 11 == 0).alias("pricing"))


CUSTOMERS = f"c AS (SELECT c_custkey AS question_id, {STATUS_SQL.replace('o_orderkey', 'c_custkey')} AS status, c_custkey % 11 = 0 AS pricing FROM customer)"


@query(f"WITH {VERSIONS} SELECT c_custkey AS question_id, CAST(coalesce(max(version), 0) + 1 AS INTEGER) AS version FROM customer LEFT JOIN v ON question_id = c_custkey GROUP BY 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the number of each question's next version."""
    return A.next_versions(_customers(spark, sf_dir), _versions(spark, sf_dir))


@query(
    f"""WITH {VERSIONS}, a AS (SELECT question_id, -question_id - 1 AS answer_id, max(version) + 1 AS version FROM v WHERE question_id % 3 = 0 GROUP BY 1)
SELECT question_id, answer_id, CAST(version AS INTEGER) AS version, is_current AND question_id % 3 <> 0 AS is_current FROM v UNION ALL SELECT question_id, answer_id, version, true FROM a"""
)
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version takes the place of the current one."""
    v = _versions(spark, sf_dir)
    added = A.next_versions(v.where("question_id % 3 = 0").select("question_id").distinct(), v).withColumn("answer_id", -F.col("question_id") - 1)
    return A.with_current(v, added)


@query(f"WITH {VERSIONS} SELECT question_id, answer_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY version DESC) AS INTEGER) AS place FROM v")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version first."""
    return A.version_history(_versions(spark, sf_dir)).select("question_id", "answer_id", "place")


@query(f"WITH {CUSTOMERS} SELECT question_id, status IN ('writer_edited', 'sme_verified', 'approved') AND question_id % 2 = 1 AS displaces FROM c")
def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions ask for confirmation before a new draft."""
    return _customers(spark, sf_dir).select("question_id", A.displaces(F.col("status"), F.col("question_id") % 2 == 0).alias("displaces"))


KEY = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def _line():
    """A line item as a sentence; sentences of an answer stand in the order of these structs."""
    status = F.when(F.col("l_linestatus") == "F", "connective").otherwise(_pick(F.col("l_partkey"), "supported", "weak", "unsupported", "human_authored"))
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", status.alias("support_status"), F.when(F.col("l_linestatus") == "F", "connective").otherwise("substantive").alias("kind"))


def _numbered_lines(spark, sf):
    """The rows of _segments with their numbers: answer_id, index, kind, l_partkey, l_suppkey."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer_id"), _line().alias("s")).select("answer_id", "s.*")
    at = F.row_number().over(Window.partitionBy("answer_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "support_status", "kind"))
    return lines.select("answer_id", at.alias("index"), "kind", "l_partkey", "l_suppkey")


def _segments(spark, sf):
    """Line items as numbered sentences of an order's answer."""
    line = _line()
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    seg = lambda x, i: F.struct(
        (i + 1).alias("index"), F.expr("0").alias("paragraph"), F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("text"), x["kind"].alias("kind"), x["support_status"].alias("support_status"),
        F.array(x["l_suppkey"].cast("string")).alias("sources"), F.lit(None).cast("string").alias("dispute"),
    )
    return lines.select("answer_id", F.transform("lines", seg).alias("segments"))


SEGMENTS = f"""s AS (SELECT l_orderkey AS answer_id, {KEY} AS index, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'connective' ELSE 'substantive' END AS kind,
  CASE WHEN l_linestatus = 'F' THEN 'connective' ELSE ['supported', 'weak', 'unsupported', 'human_authored'][l_partkey % 4 + 1] END AS support_status FROM lineitem)"""


@query(
    f"""WITH {SEGMENTS}, a AS (SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 2 = 0 THEN 'attest' ELSE 'dispute' END AS action, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'why' END AS note FROM orders),
t AS (SELECT s.*, action, CASE WHEN s.index > 2 THEN NULL WHEN action = 'attest' AND support_status IN ('weak', 'unsupported', 'human_authored') THEN 'attested'
  WHEN action = 'dispute' AND support_status = 'supported' AND note <> ' ' THEN 'disputed' ELSE 'refused' END AS outcome FROM s JOIN a USING (answer_id)),
u AS (SELECT *, CASE outcome WHEN 'attested' THEN 'supported' WHEN 'disputed' THEN 'unsupported' ELSE support_status END AS now FROM t)
SELECT answer_id, string_agg(now, ',' ORDER BY index) AS statuses, count(*) FILTER (outcome = 'attested') AS n_attested, count(*) FILTER (outcome = 'disputed') AS n_disputed, count(*) FILTER (outcome = 'refused') AS n_refused,
  (answer_id % 7 = 0 OR bool_or(outcome IS NOT DISTINCT FROM 'disputed')) AND bool_or(kind = 'substantive' AND now IN ('weak', 'unsupported')) AS needs_review FROM u GROUP BY 1"""
)
def acted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attestations and disputes of the first two sentences of every answer."""
    k = F.col("o_orderkey")
    orders = _orders(spark, sf_dir)
    actions = orders.select(
        k.alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("index"), F.when(k % 2 == 0, "attest").otherwise("dispute").alias("action"),
        F.lit("ann").alias("actor"), F.when(k % 3 == 0, "\n\t").otherwise("why").alias("note"),
    )
    done = A.act(_segments(spark, sf_dir).withColumn("needs_review", F.col("answer_id") % 7 == 0), actions)
    n = lambda v: F.size(F.filter("events", lambda e: e["outcome"] == v)).cast("long").alias(f"n_{v}")
    statuses = F.array_join(F.transform("segments", lambda s: s["support_status"]), ",")
    return done.select("answer_id", statuses.alias("statuses"), n("attested"), n("disputed"), n("refused"), "needs_review")


@query(
    "SELECT o_orderkey AS question_id, gap, lower(gap) IN (lower(o_orderpriority), lower(o_orderstatus)) AS accepted FROM (SELECT *, ['  high ', 'URGENT', 'f', 'medium', 'o'][o_orderkey % 5 + 1] AS raw, trim(raw) AS gap FROM orders)"
)
def acknowledged_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that equal one of the answer's in normal form."""
    o = _orders(spark, sf_dir)
    held = o.select(F.col("o_orderkey").alias("question_id"), F.array("o_orderpriority", "o_orderstatus").alias("gaps"))
    asked = o.select(F.col("o_orderkey").alias("question_id"), _pick(F.col("o_orderkey"), "  high ", "URGENT", "f", "medium", "o").alias("gap"))
    return A.acknowledge(held, asked).withColumn("gap", F.trim("gap"))


@query(
    f"""WITH {VERSIONS}, cur AS (SELECT question_id, answer_id FROM v WHERE is_current), nx AS (SELECT question_id, max(version) + 1 AS version FROM v GROUP BY 1),
e AS (SELECT c_custkey AS question_id, unnest([0, 1]) AS twice FROM customer),
j AS (SELECT e.*, coalesce(answer_id, -1) AS base0, answer_id, CASE WHEN e.question_id % 4 = 0 THEN 7 ELSE answer_id END AS base_id, CASE WHEN e.question_id % 7 = 0 THEN ' ' ELSE 'Text ' || twice || '.' END AS text FROM e LEFT JOIN cur USING (question_id)),
f AS (SELECT *, base_id IS NOT DISTINCT FROM answer_id AS fits, trim(text) = '' AS blank FROM j)
SELECT f.question_id, text, CASE WHEN NOT fits OR (NOT blank AND twice = 1) THEN 'stale' WHEN blank THEN 'empty' ELSE 'saved' END AS outcome,
  CAST(CASE WHEN fits AND NOT blank AND twice = 0 THEN coalesce(version, 1) END AS INTEGER) AS version FROM f LEFT JOIN nx USING (question_id)"""
)
def judged_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of every question, some on a stale base, some empty."""
    v, k = _versions(spark, sf_dir), F.col("question_id")
    current = v.where("is_current").select("question_id", F.col("answer_id").alias("now"))
    edits = _customers(spark, sf_dir).join(current, "question_id", "left").withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    edits = edits.select(
        "question_id", F.when(k % 4 == 0, F.lit(7).cast("long")).otherwise(F.col("now")).alias("base_id"),
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("Text "), F.col("twice").cast("string"), F.lit("."))).alias("text"),
    )
    return A.judge_edits(_customers(spark, sf_dir), v, edits)


@query(
    f"""WITH {VERSIONS}, {CUSTOMERS}, nx AS (SELECT question_id, max(version) AS top FROM v GROUP BY 1),
m AS (SELECT DISTINCT conv_id * 100 + turn AS message_id, conv_id + 1450 AS question_id, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1),
j AS (SELECT m.*, CASE WHEN role <> 'assistant' OR turn % 5 = 0 THEN 'not_saveable' WHEN status IS NULL THEN 'no_question' WHEN pricing THEN 'pricing'
  WHEN status IN ('writer_edited', 'sme_verified', 'approved') AND turn % 2 = 1 THEN 'confirm_first' ELSE 'saved' END AS outcome FROM m LEFT JOIN c USING (question_id))
SELECT message_id, j.question_id, outcome, CAST(CASE WHEN outcome = 'saved' THEN coalesce(top, 0) + row_number() OVER (PARTITION BY j.question_id, outcome ORDER BY message_id) END AS INTEGER) AS version,
  CASE WHEN outcome = 'saved' THEN 'Turn ' || turn || '. Done.' || chr(10) || chr(10) || 'Next.' END AS text, CASE WHEN outcome = 'saved' THEN 4 END AS words FROM j LEFT JOIN nx ON nx.question_id = j.question_id"""
)
def saved_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages saved as answers, and why others are not."""
    one = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    s = lambda p, t: F.struct(F.lit(p).alias("paragraph"), t.alias("text"))
    said = F.array(s(0, F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit("."))), s(0, F.lit("Done.")), s(1, F.lit("Next.")))
    messages = one.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), (F.col("conv_id") + 1450).alias("question_id"), "role",
        F.when(F.col("turn") % 5 != 0, said).alias("segments"), (F.col("turn") % 2 == 0).alias("confirmed"),
    )
    return A.answers_from_messages(messages, _customers(spark, sf_dir), _versions(spark, sf_dir))


@query(
    """WITH r AS (SELECT o_orderkey AS k, ['A', 'B', 'C', NULL][o_orderkey % 4 + 1] AS old, ['A', 'C', NULL, 'B', 'C'][o_orderkey % 5 + 1] AS new, o_orderkey % 3 > 0 AS sets_class, o_orderkey % 7 = 0 AS sets_date, o_custkey % 9 AS d, o_orderkey % 2 = 0 AS patched FROM orders),
t AS (SELECT *, patched AND sets_class AND new IS DISTINCT FROM old AS changed FROM r)
SELECT k AS requirement_id, old AS previous, CASE WHEN changed THEN new ELSE old END AS compliance_class,
  CASE WHEN patched AND sets_date THEN d WHEN changed AND new IN ('A', 'C') THEN NULL ELSE k END AS compliant_by, CASE WHEN changed THEN CASE WHEN new IS NOT NULL THEN 'ann' END ELSE 'bob' END AS rated_by, changed FROM t"""
)
def rated_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed class stamps, a cleared one clears; A and C clear the date unless it is set."""
    k, o = F.col("o_orderkey"), _orders(spark, sf_dir)
    rows = o.select(k.alias("requirement_id"), _pick(k, "A", "B", "C", None).alias("compliance_class"), k.alias("compliant_by"), F.lit("bob").alias("rated_by"))
    patches = o.where(k % 2 == 0).select(
        k.alias("requirement_id"), _pick(k, "A", "C", None, "B", "C").alias("new_class"), (k % 3 > 0).alias("sets_class"), (F.col("o_custkey") % 9).alias("new_date"), (k % 7 == 0).alias("sets_date"), F.lit("ann").alias("actor")
    )
    return A.rate_requirements(rows, patches)


@query(
    """WITH q AS (SELECT o_custkey AS pack_id, o_orderkey AS question_id, o_orderkey * 10 AS answer_id, o_orderpriority || ' ' || o_orderstatus AS heading, 'Q' || o_orderkey AS text, 'Answer of ' || o_orderkey AS answer_text FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0), l AS (SELECT o_custkey AS pack_id, max(o_orderkey % 3) AS last FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT q.pack_id, question_id, answer_id, heading, heading || chr(10) || text || chr(10) || chr(10) || answer_text AS section_text,
  CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY q.pack_id ORDER BY question_id) AS BIGINT) AS order_index, CAST(length(heading) + 1 AS INTEGER) AS question_start,
  CAST(length(heading) + 1 + length(text) AS INTEGER) AS question_end, CAST(length(heading) + length(text) + 3 AS INTEGER) AS answer_start, CAST(length(heading) + length(text) + 3 + length(answer_text) AS INTEGER) AS answer_end
FROM q LEFT JOIN l USING (pack_id)"""
)
def promoted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved answers that are not in the library yet, with spans by construction."""
    k, o = F.col("o_orderkey"), _orders(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") != "P", "approved").otherwise("ai_draft")
    questions = o.select(
        F.col("o_custkey").alias("pack_id"), k.alias("question_id"), F.col("o_orderpriority").alias("section"), F.col("o_orderstatus").alias("number"),
        F.concat(F.lit("Q"), k.cast("string")).alias("text"), status.alias("status"), k.alias("order_index"),
    )
    text = F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Answer of "), k.cast("string")))
    answers = o.select(k.alias("question_id"), (k * 10).alias("answer_id"), text.alias("answer_text"), F.lit(True).alias("is_current"))
    stored = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("pack_id"), (k % 3).alias("order_index"))
    return A.promote(questions, answers, answers.where("question_id % 5 = 0").select("answer_id"), stored)


def _cited(segments):
    """Sources of the sentences: suppliers as items, and for every third line the supplier's fact; some unknown, some attested."""
    seg = segments.select("answer_id", "index", F.col("l_suppkey").alias("sid"))
    key = F.col("answer_id") + F.col("index")
    kind = F.when(key % 13 == 0, "human_attestation").when(key % 3 == 0, "fact").otherwise("knowledge_item")
    quote = F.when(key % 4 == 0, "entirely unlike words 77").otherwise(F.concat(F.lit("holds ACCOUNT number "), F.col("sid").cast("string")))
    return seg.select("answer_id", "index", kind.alias("source_type"), F.when(key % 11 == 0, F.col("sid") + 10**6).otherwise(F.col("sid")).alias("source_id"), quote.alias("quote"))


def _sentence(k):
    return F.concat(F.lit("This supplier holds account number "), k.cast("string"), F.lit(" with us."))


@query(
    f"""WITH {SEGMENTS}, c AS (SELECT *, answer_id + index AS key FROM s), d AS (SELECT *, CASE WHEN key % 13 = 0 THEN 'human_attestation' WHEN key % 3 = 0 THEN 'fact' ELSE 'knowledge_item' END AS t FROM c),
f AS (SELECT *, t <> 'human_attestation' AND key % 11 <> 0 AND CASE t WHEN 'fact' THEN l_suppkey % 9 <> 0 ELSE key % 4 <> 0 END AS found FROM d)
SELECT answer_id, CAST(index AS INTEGER) AS index, CASE WHEN kind = 'connective' THEN 'connective' WHEN t = 'human_attestation' THEN 'supported' WHEN NOT found THEN 'unsupported'
  WHEN t = 'fact' AND l_suppkey % 2 = 0 THEN 'weak' WHEN l_partkey % 2 = 0 THEN 'supported' ELSE 'weak' END AS support_status, CASE WHEN found THEN 1 ELSE 0 END AS n_found FROM f"""
)
def verified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences against the items and facts that they cite, all outcomes."""
    segments = written(_numbered_lines(spark, sf_dir), "segments")
    said = F.when(F.col("l_partkey") % 2 == 0, "One account holds a number.").otherwise("Nothing in common here.")
    rows = segments.select("answer_id", "index", "kind", said.alias("text"))
    k, s = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    items = s.select(k.alias("item_id"), _sentence(k).alias("text"), F.lit(100).alias("base"))
    body = F.concat(F.lit("Before. "), F.when(k % 9 == 0, "Quite another text without it.").otherwise(_sentence(k)))
    facts = s.select(k.alias("fact_id"), _sentence(k).alias("statement"), body.alias("section_text"), (k % 2 != 0).alias("is_current"))
    out = V.verify_segments(rows, _cited(segments), items, facts)
    return out.select("answer_id", "index", "support_status", F.col("n_found").cast("int").alias("n_found"))


@query(
    """WITH n AS (SELECT l_orderkey AS answer_id, l_suppkey AS fact_id, min(l_partkey * 8 + l_linenumber) AS position FROM lineitem GROUP BY ALL)
SELECT answer_id, fact_id, CASE WHEN fact_id % 5 = 0 OR fact_id % 7 = 0 THEN 'superseded' WHEN fact_id % 4 = 1 THEN 'expired' WHEN fact_id % 9 <> 0 THEN 'current' ELSE 'unverified' END AS status,
  row_number() OVER (PARTITION BY answer_id ORDER BY position, fact_id) AS place FROM n JOIN supplier ON s_suppkey = fact_id AND s_acctbal > 0"""
)
def fact_checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist of every answer's facts."""
    k = F.col("s_suppkey")
    named = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("position"), F.col("l_suppkey").alias("fact_id"))
    facts = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(
        k.alias("fact_id"), _sentence(k).alias("statement"), F.when(k % 9 == 0, "Other words.").otherwise(F.upper(_sentence(k))).alias("section_text"),
        F.when(k % 5 == 0, 1).alias("superseded_by"), F.when(k % 7 == 0, 1).alias("document_superseded_by"), F.lit(None).cast("timestamp").alias("expired_at"),
        F.when(k % 4 == 1, F.lit("2020-01-01").cast("date")).otherwise(F.lit("2030-01-01").cast("date")).alias("expires_on"),
    )
    out = V.fact_checklist(named, facts, F.lit("2025-01-01").cast("date"))
    return out.withColumn("place", F.col("place").cast("long"))


@query()
def verbatim_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a stored answer as supported segments; offsets are checked against the text in the tests."""
    return V.verbatim_segments(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.lit(50).alias("base")))


@query(
    f"""WITH {SEGMENTS}, g AS (SELECT s_suppkey, CASE s_suppkey % 12 WHEN 0 THEN 'removed' WHEN 10 THEN 'superseded' ELSE ['superseded', 'expired', 'removed'][s_suppkey % 3 + 1] END AS reason FROM supplier WHERE s_acctbal < 2000),
t AS (SELECT s.*, reason, reason IS NOT NULL AND kind = 'substantive' AND support_status <> 'weak' AS changes FROM s LEFT JOIN g ON s_suppkey = l_suppkey),
c AS (SELECT answer_id, first(l_suppkey ORDER BY index) AS fact FROM s GROUP BY 1), k AS (SELECT answer_id, CASE reason WHEN 'superseded' THEN 'superseded' WHEN 'expired' THEN 'expired' WHEN 'removed' THEN 'unverified' ELSE 'expired' END AS entry, coalesce(reason, 'expired') <> 'expired' AS moved FROM c LEFT JOIN g ON s_suppkey = fact)
SELECT t.answer_id, string_agg(CASE WHEN changes THEN 'weak' ELSE support_status END, ',' ORDER BY index) AS statuses, any_value(entry) AS entry, coalesce(string_agg(CASE WHEN changes THEN index END, ',' ORDER BY index), '') AS changed,
  bool_or(kind = 'substantive' AND (changes OR support_status IN ('weak', 'unsupported'))) AS needs_review FROM t JOIN k USING (answer_id) GROUP BY t.answer_id HAVING bool_or(changes) OR bool_or(moved)"""
)
def invalidation_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stale sources do to sentences, checklists and review flags; several reasons a source, items with the ids of facts."""
    answers = _segments(spark, sf_dir).select(
        "answer_id", F.col("answer_id").alias("question_id"), F.lit(False).alias("needs_review"), "segments",
        F.array(F.struct(F.col("segments")[0]["sources"][0].alias("fact_id"), F.lit("expired").alias("status"))).alias("checklist"),
    )
    k, suppliers = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    more = F.when(k % 12 == 0, F.array(F.lit("expired"), F.lit("removed"))).when(k % 12 == 10, F.array(F.lit("superseded"), F.lit("expired")))
    reasons = F.coalesce(more, F.array(_pick(k, "superseded", "expired", "removed")))
    facts = suppliers.where("s_acctbal < 2000").select(F.lit("fact").alias("source_type"), k.cast("string").alias("source_id"), F.explode(reasons).alias("reason"))
    stale = facts.union(suppliers.select(F.lit("knowledge_item"), k.cast("string"), F.lit("removed")))
    statuses = F.array_join(F.transform("segments", lambda s: s["support_status"]), ",")
    return V.invalidation_effects(answers, stale).select(
        "answer_id", statuses.alias("statuses"), F.col("checklist")[0]["status"].alias("entry"), F.array_join(F.transform("changed", lambda i: i.cast("string")), ",").alias("changed"), "needs_review"
    )


@query(
    f"""WITH {SEGMENTS}, t AS (SELECT *, kind = 'substantive' AND support_status <> 'weak' AND l_suppkey % 2 = 0 AS moves FROM s WHERE answer_id % 4 = 0)
SELECT answer_id, count(*) FILTER (moves) AS n_changed, ['current', 'superseded', 'unverified'][answer_id % 3 + 1] AS entry,
  count(*) FILTER (moves) > 0 AND bool_or(kind = 'substantive' AND (moves OR support_status IN ('weak', 'unsupported'))) AS needs_review
FROM t GROUP BY 1 HAVING n_changed > 0 OR answer_id % 3 > 0"""
)
def revalidated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions just saved from messages meet what went stale before; entries of facts that no sentence cites ask for no review."""
    entry = F.struct(F.concat(F.lit("u"), (F.col("answer_id") % 3).cast("string")).alias("fact_id"), F.lit("current").alias("status"))
    answers = _segments(spark, sf_dir).select("answer_id", F.col("answer_id").alias("question_id"), F.lit(False).alias("needs_review"), "segments", F.array(entry).alias("checklist"))
    saved = _orders(spark, sf_dir).where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("answer_id"))
    stale = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("source_id"), F.lit("expired").alias("reason"))
    uncited = spark.createDataFrame([("u1", "expired"), ("u1", "superseded"), ("u2", "superseded"), ("u2", "removed")], stale.schema)
    return V.revalidate(answers, saved, stale.union(uncited)).select("answer_id", F.size("changed").cast("long").alias("n_changed"), F.col("checklist")[0]["status"].alias("entry"), "needs_review")


@query(
    """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 6 < 4 THEN c_custkey WHEN c_custkey % 6 = 4 THEN c_custkey + 1000000 END AS item_id,
  ['equality', 'equality_without_number', 'span_verbatim', 'span_near', 'section'][c_custkey % 6 + 1] AS method FROM customer WHERE c_custkey % 6 < 5"""
)
def resolved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the cascade, by customer: equal, without number, verbatim within, near, by section, none.

    Each document has two pairs, and the text first stands in a section without any."""
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    step, name = k % 6, F.concat(F.lit("Describe how customer "), k.cast("string"), F.lit(" is served in every region of the country"))
    stored = (
        F.when(step == 0, F.upper(name)).when(step == 1, F.concat(F.lit("4.2 "), name)).when(step == 2, F.concat(F.lit("Please answer fully. "), name, F.lit(" Thanks.")))
        .when(step == 3, F.replace(name, F.lit("country"), F.lit("county"))).otherwise(F.lit("zzz 999"))
    )
    queries = c.select(k.alias("query_id"), k.alias("document"), name.alias("text"))
    pair = lambda item, place, question, start, end: c.select(
        item.alias("item_id"), k.alias("document"), F.lit(place).alias("place"), question.alias("question"), F.lit(5).alias("section_id"),
        F.lit(start).alias("question_start"), F.lit(end).alias("question_end"),
    )
    other = F.when(step == 0, name).otherwise(F.lit("Another matter 123"))
    pairs = pair(k, 1, stored, 0, 7).union(pair(k + 1_000_000, 2, other, 7, 90))
    body = F.concat(F.lit("Intro. "), name, F.lit(" Outro."))
    sections = c.where("c_custkey % 6 = 4").select(k.alias("document"), F.inline(F.array(*[F.struct(F.lit(i).alias("section_id"), F.lit(p).alias("place"), body.alias("text")) for i, p in ((6, 1), (5, 0), (4, -1))])))
    return V.resolve_questions(queries, pairs, sections)


@query("SELECT o_orderkey AS truth_id, l_partkey AS run_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def truth_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and runs by section and number, blanks around them aside."""
    truth = _orders(spark, sf_dir).select(F.lit(" S ").alias("section"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("number"), F.col("o_orderkey").alias("truth_id"))
    runs = table(spark, sf_dir, "lineitem").select(F.lit("S").alias("section"), F.concat(F.col("l_orderkey").cast("string"), F.lit("  ")).alias("number"), F.col("l_partkey").alias("run_id"))
    return V.truth_with_runs(truth, runs).select("truth_id", "run_id")


@query("SELECT o_orderkey AS label_id, c_custkey AS pair_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 > 0")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and pairs by four keys in normal form."""
    text = lambda c, pre: F.concat(F.lit(pre), c.cast("string"))
    k = F.col("o_custkey")
    labels = _orders(spark, sf_dir).where("o_custkey % 3 > 0").select(
        F.col("o_orderkey").alias("label_id"), text(k, "File  ").alias("a"), F.lit("“One”").alias("b"), text(k, "Q–").alias("c"), F.lit(None).cast("string").alias("d")
    )
    c = F.col("c_custkey")
    pairs = table(spark, sf_dir, "customer").select(c.alias("pair_id"), text(c, "file ").alias("a"), F.lit('"one"').alias("b"), text(c, "q-").alias("c"), F.lit("").alias("d"))
    return V.labelled_pairs(labels, pairs, ["a", "b", "c", "d"]).select("label_id", "pair_id")
