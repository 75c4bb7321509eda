"""From sections to windows, pairs, items and requirements; submissions are laid out from conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction
from ..operators.components import written
from .registry import query, table

#: Tokens of a window here: conversations are short, a document of ten of them has several windows.
LIMIT = 400

SUBMISSIONS = r"""turns AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
    regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS flat
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), laid AS (
  SELECT conv_id, turn AS place, flat || ' | ' || next_text AS text, 'pair' AS kind, flat AS question, next_text AS answer, 'R' || turn AS cell_ref
  FROM turns WHERE conv_id % 3 = 0 AND role = 'user' AND next_role = 'assistant'
  UNION ALL SELECT conv_id, turn, '1.' || turn || ' ' || flat || chr(10) || next_text, 'pair', '1.' || turn || ' ' || flat, next_text, NULL
  FROM turns WHERE conv_id % 3 = 1 AND role = 'user' AND next_role = 'assistant'
  UNION ALL SELECT conv_id, turn, 'Question ' || turn || chr(10) || chr(10) || flat, 'question', flat, NULL, NULL FROM turns WHERE conv_id % 3 = 2 AND role = 'user'
  UNION ALL SELECT conv_id, 1000 + turn, flat, 'answer', NULL, flat, 'R' || turn FROM turns WHERE conv_id % 3 = 2 AND role = 'assistant'
), sec AS (
  SELECT conv_id // 10 AS document_id, CAST(row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, place) - 1 AS INTEGER) AS order_index, text, kind, question,
    regexp_replace(answer, '^\s+|\s+$', '', 'g') AS answer, greatest(1, length(text) // 4) + 30 AS cost FROM laid
), fold AS (
  SELECT document_id, order_index, 0 AS win, cost AS used, cost AS last, -1 AS before FROM sec WHERE order_index = 0
  UNION ALL
  SELECT s.document_id, s.order_index, win + CASE WHEN used + s.cost > 400 THEN 1 ELSE 0 END, CASE WHEN used + s.cost > 400 THEN last ELSE used END + s.cost, s.cost,
    CASE WHEN used + s.cost > 400 THEN f.order_index ELSE -1 END
  FROM fold f JOIN sec s ON s.document_id = f.document_id AND s.order_index = f.order_index + 1
), win AS (SELECT document_id, win, order_index FROM fold UNION ALL SELECT document_id, win, before FROM fold WHERE before >= 0)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents of ten conversations: cells, numbered headings, or questions with boxed answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    flat = T.strip(F.regexp_replace(T.strip(F.col("text")), r"\s+", " "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", flat.alias("flat"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    kind, answered = F.col("conv_id") % 3, (F.col("role") == "user") & (F.col("next_role") == "assistant")
    ref = F.concat(F.lit("R"), F.col("turn").cast("string"))
    part = lambda at, text, cell: F.struct(at.cast("long").alias("at"), text.alias("text"), cell.alias("cell_ref"))
    none = F.lit(None).cast("string")
    laid = (
        F.when((kind == 0) & answered, part(F.col("turn"), F.concat_ws(" | ", "flat", "next_text"), ref))
        .when((kind == 1) & answered, part(F.col("turn"), F.concat(F.lit("1."), F.col("turn").cast("string"), F.lit(" "), F.col("flat"), F.lit("\n"), F.col("next_text")), none))
        .when((kind == 2) & (F.col("role") == "user"), part(F.col("turn"), F.concat(F.lit("Question "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("flat")), none))
        .when((kind == 2) & (F.col("role") == "assistant"), part(F.col("turn") + 1000, F.col("flat"), ref))
    )
    rows = turns.select(F.floor(F.col("conv_id") / 10).alias("document_id"), "conv_id", laid.alias("s")).where("s is not null").select("document_id", "conv_id", "s.*")
    at = (F.row_number().over(Window.partitionBy("document_id").orderBy("conv_id", "at")) - 1).cast("int")
    return rows.select("document_id", at.alias("order_index"), "text", "cell_ref", F.array(F.lit("Submission")).alias("heading_path"))


@query(f"WITH RECURSIVE {SUBMISSIONS} SELECT document_id, CAST(win AS INTEGER) AS \"window\", order_index FROM win")
def submission_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a submission in windows of about 400 tokens, one section of overlap."""
    return extraction.windowed(submissions(spark, sf_dir), LIMIT).select("document_id", "window", "order_index")


QUEUE = rf"""WITH RECURSIVE {SUBMISSIONS}, ev AS (
  SELECT win.document_id, win, order_index, kind, question, answer, row_number() OVER (PARTITION BY win.document_id, win ORDER BY order_index) AS n FROM win JOIN sec USING (document_id, order_index)
), queue AS (
  SELECT DISTINCT document_id, win, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT("at" INTEGER, q VARCHAR)[]) AS waits, CAST(NULL AS STRUCT("at" INTEGER, q VARCHAR)) AS hit FROM win
  UNION ALL
  SELECT e.document_id, e.win, e.n, CASE kind WHEN 'question' THEN list_append(waits, {{'at': order_index, 'q': question}}) WHEN 'answer' THEN waits[2:] ELSE waits END,
    CASE WHEN kind = 'answer' AND len(waits) > 0 THEN waits[1] END
  FROM queue f JOIN ev e ON e.document_id = f.document_id AND e.win = f.win AND e.n = f.n + 1
)"""


@query(
    QUEUE
    + r"""SELECT document_id, CAST(win AS INTEGER) AS "window", CAST(row_number() OVER (PARTITION BY document_id, win ORDER BY order_index) AS INTEGER) AS seq,
  CAST(CASE kind WHEN 'pair' THEN order_index ELSE hit."at" END AS VARCHAR) AS question_section, CAST(order_index AS VARCHAR) AS answer_section,
  CASE kind WHEN 'pair' THEN question ELSE hit.q END AS question, answer,
  array_to_string(string_split(regexp_replace(answer, '\s+', ' ', 'g'), ' ')[1:6], ' ') AS answer_first, array_to_string(string_split(regexp_replace(answer, '\s+', ' ', 'g'), ' ')[-6:], ' ') AS answer_last
FROM queue JOIN ev USING (document_id, win, n) WHERE kind = 'pair' OR hit IS NOT NULL"""
)
def extracted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs of each window, labelled questions met by the answers that follow them."""
    pairs, _ = extraction.extracted_pairs(extraction.windowed(submissions(spark, sf_dir), LIMIT))
    return pairs.select(
        "document_id", "window", "seq", "question_section", "answer_section", F.col("question_copy").alias("question"), F.col("answer_copy").alias("answer"), "answer_first", "answer_last"
    )


@query(
    QUEUE
    + r"""SELECT document_id, CAST(win AS INTEGER) AS "window", 'answer' AS role, CAST(order_index AS VARCHAR) AS section, answer AS text
FROM queue JOIN ev USING (document_id, win, n) WHERE kind = 'answer' AND hit IS NULL
UNION ALL SELECT document_id, CAST(win AS INTEGER), 'question', CAST(w."at" AS VARCHAR), w.q
FROM (SELECT document_id, win, unnest(waits) AS w FROM queue QUALIFY n = max(n) OVER (PARTITION BY document_id, win))"""
)
def spare_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that found no question waiting, questions that still wait at their window's end."""
    _, fragments = extraction.extracted_pairs(extraction.windowed(submissions(spark, sf_dir), LIMIT))
    return fragments.drop("seq")


def _model_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs as a model gives them: some name no section, copy wrongly, or miss an anchor."""
    n = (F.col("document_id") + F.col("window") + F.col("seq")) % 6
    return (
        pairs.withColumn("answer_section", F.when(n <= 1, "none").otherwise(F.col("answer_section")))
        .withColumn("answer_copy", F.when(n == 1, "words that stand nowhere").otherwise(F.col("answer_copy")))
        .withColumn("answer_first", F.when(n == 2, "not there").otherwise(F.col("answer_first")))
        .withColumn("question_section", F.when(n == 3, "none").otherwise(F.col("question_section")))
        .withColumn("question_copy", F.when(n == 3, F.upper("question_copy")).otherwise(F.col("question_copy")))
    )


@query()
def resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the spans of their questions and answers, from pairs with a model's faults."""
    sections = written(extraction.windowed(written(submissions(spark, sf_dir), "submissions"), LIMIT), "sections")
    pairs, _ = extraction.extracted_pairs(sections)
    pairs = written(_model_pairs(pairs).select("document_id", "window", "seq", *extraction.PAIR), "pairs")
    return extraction.resolved_pairs(sections, pairs).drop("answer_key")


@query(
    r"""SELECT o_orderkey AS document_id, 0 AS order_index, 0 AS sub, 'R' || o_orderkey AS ref, 'Order ' || o_orderkey || ' must ship' AS text,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'should' WHEN o_orderpriority LIKE '2%' THEN 'could' ELSE 'must' END AS priority FROM orders WHERE o_orderpriority NOT LIKE '3%'
UNION ALL SELECT o_orderkey, 1, i, CASE i WHEN 0 THEN '1.' || o_orderkey END, t, p FROM orders,
  (VALUES (0, 'It shall arrive.', 'must'), (1, 'It could wait.', 'could')) v(i, t, p)"""
)
def extracted_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of rows and sentences, one specification for each order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").cast("string").alias("k"), F.substring("o_orderpriority", 1, 1).alias("p"))
    level = F.when(F.col("p") == "1", " | Desirable").when(F.col("p") == "2", " | C").otherwise("")
    row = F.concat(F.lit("R"), F.col("k"), F.lit(" | Order "), F.col("k"), F.lit(" must ship"), F.when(F.col("p") == "3", "?").otherwise(""), level)
    prose = F.concat(F.lit("1."), F.col("k"), F.lit(" It shall arrive. It could wait. Must it? No."))
    none = F.array().cast("array<string>")
    sections = o.select(
        "document_id",
        F.inline(F.array(
            F.struct(F.lit(0).alias("order_index"), row.alias("text"), F.lit("A1").alias("cell_ref"), none.alias("heading_path")),
            F.struct(F.lit(1).alias("order_index"), prose.alias("text"), F.lit(None).cast("string").alias("cell_ref"), none.alias("heading_path")),
            F.struct(F.lit(2).alias("order_index"), row.alias("text"), F.lit("A2").alias("cell_ref"), F.array(F.lit("Question")).alias("heading_path")),
        )),
    )
    return extraction.extracted_requirements(sections).drop("topics")
