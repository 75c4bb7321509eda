"""Drafts and streamed lines over benchmark texts, documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import simple_sentences
from ..operators import drafting as D
from ..operators import retrieval as R
from ..operators.components import written
from ..operators.listing import rounded
from .registry import query, table
from .retrieval_queries import _items, _queries

WORDS = ", ".join(f"'{w}'" for w in D.INSTRUCTION_WORDS)


@query(
    f"""WITH t AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r') AS said, trim(first(text ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn), E' \\t\\n\\r') AS asked
  FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN left(coalesce(text, ''), 20) || ' a shorter paragraph' ELSE coalesce(text, '') END AS text FROM conversations))
SELECT conv_id, turn, CASE WHEN asked <> '' AND list_bool_or(list_transform([{WORDS}], lambda w: contains(lower(said), w))) THEN asked ELSE said END AS query FROM t"""
)
def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every turn of a conversation retrieves with; every third asks for another form of the draft."""
    text = F.coalesce("text", F.lit(""))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.concat(F.substring(text, 1, 20), F.lit(" a shorter paragraph"))).otherwise(text).alias("text"))
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"))
    return turns.join(first, "conv_id").select("conv_id", "turn", D.rewritten_query(F.col("text"), F.col("asked")).alias("query"))


@query()
def synthesised_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft of every benchmark text from its best eight documents; the second sentence of the best three is a
    fact of its document, no longer current in every fourth."""
    questions = _queries(spark, sf_dir).select(
        F.col("query_id").alias("question_id"), "text", F.when(F.col("query_id") % 5 == 0, "shorter, please").alias("instruction"),
        F.when(F.col("query_id") % 11 == 0, "pricing").otherwise("text").alias("response_type"), F.when(F.col("query_id") % 2 == 0, "Northern Trust").alias("buyer"),
    )
    top = written(R.lexical_list(_items(spark, sf_dir), _queries(spark, sf_dir), most=8).select("query_id", "item_id", "rank"), "top")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", "lang").join(top.select("item_id").distinct(), "item_id")
    found = written(top.join(docs, "item_id").select(F.col("query_id").alias("question_id"), "rank", "item_id", "text", "lang"), "found")
    stated = F.try_element_at(simple_sentences(F.col("text"), complete_only=True), F.lit(2))
    facts = found.where("rank <= 3").select("question_id", F.col("rank").alias("position"), F.col("item_id").alias("fact_id"), F.col("lang").alias("kind"), stated.alias("statement"), (F.col("item_id") % 4 == 0).alias("expired"))
    drafts = D.synthesised(questions, found, facts)
    rows = drafts.select("question_id", "gaps", "fact_ids", F.explode_outer("segments").alias("s"))
    return rows.select("question_id", "s.index", "s.paragraph", "s.kind", "s.text", F.size("s.sources").alias("n_sources"), "fact_ids", "gaps")


def _streams(spark, sf):
    """Orders as the lines of a customer's stream, by order: good ones of each type, one cut short, an unknown type, a
    fence, a wrong field; every seventh customer's is one object in a fence. Cut into chunks of 50 characters."""
    k, text, status, cust = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")
    lit = lambda v, n: F.lit(v).alias(n)
    cited = F.array(F.struct(lit("fact", "source_type"), k.cast("string").alias("source_id")))
    line = (
        F.when(k % 7 == 0, F.to_json(F.struct(lit("segment", "type"), text.alias("text"), (k % 3).alias("paragraph"), cited.alias("sources"))))
        .when(k % 7 == 1, F.to_json(F.struct(lit("gaps", "type"), F.array(status, text).alias("gaps"))))
        .when(k % 7 == 2, F.to_json(F.struct(lit("fact_checklist", "type"), F.array(k.cast("string")).alias("fact_ids"))))
        .when(k % 7 == 3, F.concat(F.lit('{"type":"segment","text":"'), text))
        .when(k % 7 == 4, F.to_json(F.struct(lit("note", "type"), text.alias("text"))))
        .when(k % 7 == 5, F.lit("```json"))
        .otherwise(F.to_json(F.struct(lit("segment", "type"), text.alias("text"), lit(1.5, "paragraph"))))
    )
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"), text.alias("text"), status.alias("status")))).alias("l"))
    each = lambda name: F.transform("l", lambda x: x[name])
    whole = F.to_json(F.struct(F.transform("l", lambda x: F.struct(x["text"].alias("text"))).alias("segments"), F.array_distinct(each("status")).alias("gaps"), F.array(cust.cast("string")).alias("fact_ids")))
    body = F.when(cust % 7 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(F.array_join(each("line"), "\n"))
    cuts = per.select(cust.alias("stream_id"), body.alias("body")).select("stream_id", "body", F.explode(F.sequence(F.lit(0), F.floor(F.length("body") / 50).cast("int"))).alias("position"))
    return cuts.select("stream_id", "position", F.substring("body", F.col("position") * 50 + 1, F.lit(50)).alias("chunk"))


@query(
    """WITH o AS (SELECT o_custkey AS stream_id, o_orderkey AS k, o_orderkey % 7 AS m, o_orderpriority AS p, o_orderstatus AS s,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
lines AS (SELECT stream_id, place, false AS whole, CASE WHEN m IN (0) THEN 'segment' WHEN m = 1 THEN 'gaps' WHEN m = 2 THEN 'fact_checklist' END AS type,
  CASE m WHEN 3 THEN 'not json' WHEN 4 THEN 'unknown type' WHEN 6 THEN 'bad field' END AS problem, CASE WHEN m = 0 THEN p END AS text, CASE WHEN m = 0 THEN k % 3 END AS paragraph,
  CASE WHEN m = 0 THEN 'fact:' || k END AS cited, CASE WHEN m = 1 THEN s || '|' || p END AS gaps, CASE WHEN m = 2 THEN CAST(k AS VARCHAR) END AS fact_ids
  FROM o WHERE stream_id % 7 <> 0 AND m <> 5),
firsts AS (SELECT stream_id, s, min(place) AS place FROM o WHERE stream_id % 7 = 0 GROUP BY ALL),
ends AS (SELECT stream_id, max(place) + 1 AS n FROM o WHERE stream_id % 7 = 0 GROUP BY 1),
every AS (
  SELECT * FROM lines
  UNION ALL SELECT stream_id, place, true, 'segment', NULL, p, 0, '', NULL, NULL FROM o WHERE stream_id % 7 = 0
  UNION ALL SELECT stream_id, any_value(n), true, 'gaps', NULL, NULL, NULL, NULL, string_agg(s, '|' ORDER BY place), NULL FROM firsts JOIN ends USING (stream_id) GROUP BY stream_id
  UNION ALL SELECT stream_id, n + 1, true, 'fact_checklist', NULL, NULL, NULL, NULL, NULL, CAST(stream_id AS VARCHAR) FROM ends)
SELECT stream_id, CAST(place AS INTEGER) AS place, whole, type, problem, text, CAST(paragraph AS INTEGER) AS paragraph, cited, gaps, fact_ids FROM every"""
)
def streamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every customer's stream, problems beside good ones, a whole document where no line is good."""
    rows = D.streamed_lines(_streams(spark, sf_dir))
    cited = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source_type"], s["source_id"])), "|")
    return rows.select("stream_id", "place", "whole", "type", "problem", "text", "paragraph", cited.alias("cited"), F.array_join("gaps", "|").alias("gaps"), F.array_join("fact_ids", "|").alias("fact_ids"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_quantity / 8) AS DOUBLE) AS eighths, CAST(printf('%.2f', l_quantity * 0.005) AS DOUBLE) AS halves,
  CAST(printf('%.1f', l_extendedprice * (1 - l_discount)) AS DOUBLE) AS price, CAST(printf('%.0f', -l_quantity / 2) AS DOUBLE) AS whole FROM lineitem"""
)
def rounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: quantities and prices of every line, half to even on the exact value of the double."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", rounded(q / 8, 2).alias("eighths"), rounded(q * 0.005, 2).alias("halves"),
        rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), 1).alias("price"), rounded(-q / 2, 0).alias("whole"),
    )
