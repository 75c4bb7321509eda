"""The search under every combination of its switches, over embeddings as items of two vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import hash_embedding
from ..functions.vectors import norm
from ..operators import ablation as A
from ..operators.components import written
from .registry import query, table
from .retrieval_queries import WIDTH, _vector_queries, _vectors


def _library(spark, sf):
    """Vectors as items: their own as the answer's, their own or the next one's as the question's; some lack either, some may not be ranked."""
    v, k = _vectors(spark, sf), F.col("item_id")
    later = v.select((k - 1).alias("item_id"), F.col("vector").alias("next"))
    return v.join(later, "item_id", "left").select(
        "item_id", F.when(k % 7 != 0, F.col("vector")).alias("answer_vector"), F.when(k % 3 != 0, F.when(k % 4 == 2, F.col("vector")).otherwise(F.col("next"))).alias("question_vector"), "topic",
        F.floor(k / 2).alias("cluster_id"), F.when(k % 100 != 0, "qa_pair").otherwise("text").alias("item_type"), (k % 13 != 0).alias("text_verified"), (k % 17 == 0).alias("excluded"),
    )


def _ablations(spark, sf):
    """The judge wants the forty items after the query's own id, the last first; most are not in the pool."""
    queries = _vector_queries(spark, sf)
    order = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("position")).withColumn("item_id", F.col("query_id") + 40 - F.col("position"))
    return A.ablations(_library(spark, sf), queries, order)


MATRIX = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
item AS (
  SELECT a.vec_id AS item_id, a.label, a.e AS answer, CASE WHEN a.vec_id % 4 = 2 THEN a.e ELSE b.e END AS question, a.vec_id % 7 <> 0 AS answered, a.vec_id % 3 <> 0 AND (b.later OR a.vec_id % 4 = 2) AS asked
  FROM v a JOIN (SELECT vec_id - 1 AS vec_id, e, true AS later FROM v UNION ALL SELECT vec_id, e, false FROM v WHERE vec_id + 1 NOT IN (SELECT vec_id FROM v)) b USING (vec_id) WHERE a.vec_id % 13 <> 0 AND a.vec_id % 17 <> 0
), pair AS (
  SELECT q.vec_id AS query_id, item_id, q.label = i.label AS same, 
    CASE WHEN answered THEN round(list_cosine_similarity(q.e, answer), 9) END AS sa,
    CASE WHEN asked THEN round(list_cosine_similarity(q.e, question), 9) END AS sq
  FROM v q JOIN item i ON q.vec_id % 50 = 0
), scores AS (
  SELECT query_id, item_id, same, 'max' AS vl, greatest(sa, sq) AS s FROM pair UNION ALL SELECT query_id, item_id, same, 'answer_only', sa FROM pair
), vec AS (
  SELECT vl, query_id, item_id, row_number() OVER (PARTITION BY vl, query_id ORDER BY s DESC, item_id) AS rank FROM scores WHERE s IS NOT NULL QUALIFY rank <= 20
), top AS (
  SELECT vl, query_id, item_id, row_number() OVER (PARTITION BY vl, query_id ORDER BY s DESC, item_id) AS rank FROM scores WHERE s IS NOT NULL AND same QUALIFY rank <= 20
), conf AS (SELECT tl, vl FROM (VALUES ('on'), ('off')) t(tl), (VALUES ('max'), ('answer_only')) u(vl)),
ranks AS (
  SELECT tl, vl, query_id, item_id, max(vr) AS vr, max(tr) AS tr FROM (
    SELECT tl, vl, query_id, item_id, rank AS vr, NULL AS tr FROM vec JOIN conf USING (vl)
    UNION ALL SELECT tl, vl, query_id, item_id, NULL, rank FROM top JOIN conf USING (vl) WHERE tl = 'on') GROUP BY ALL
), fused AS (
  SELECT tl, vl, query_id, item_id, coalesce(s, -1) AS s, round(coalesce(1.0 / (vr + 60), 0.0)::DOUBLE + coalesce(1.0 / (tr + 60), 0.0)::DOUBLE, 9) AS fused
  FROM ranks JOIN scores USING (vl, query_id, item_id)
), one AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY tl, vl, query_id, item_id // 2 ORDER BY fused DESC, s DESC, item_id) = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY tl, vl, query_id ORDER BY fused DESC, s DESC, item_id) AS rank FROM one QUALIFY rank <= 20),
final AS (
  SELECT tl, vl, 'off' AS rr, query_id, item_id, rank FROM kept
  UNION ALL SELECT tl, vl, 'on', query_id, item_id, row_number() OVER (PARTITION BY tl, vl, query_id
    ORDER BY CASE WHEN item_id - query_id BETWEEN 1 AND 40 THEN query_id + 40 - item_id END NULLS LAST, rank) FROM kept
)"""


@query(
    f"""WITH {MATRIX} SELECT 'topic_list=' || tl || ',vector_list=' || vl || ',llm_rerank=' || rr AS configuration, query_id, item_id, CAST(rank AS INTEGER) AS rank
FROM final WHERE rank <= 8"""
)
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible items of two vectors under all eight configurations."""
    return _ablations(spark, sf_dir).select("configuration", "query_id", "item_id", "rank")


@query(
    f"""WITH {MATRIX} SELECT query_id, item_id, round(sq, 6) AS similarity FROM final JOIN pair USING (query_id, item_id)
WHERE tl = 'on' AND vl = 'max' AND rr = 'off' AND rank = 1 AND item_id % 100 <> 0 AND sq >= 0.92"""
)
def verbatim_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of every query that asks the query's own question."""
    kept = written(_ablations(spark, sf_dir).where(F.col("configuration") == A.configurations()[0]["configuration"]), "kept")
    rows = A.verbatim_candidates(kept, _library(spark, sf_dir), _vector_queries(spark, sf_dir))
    return rows.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH q AS (SELECT item_id AS query_id, item_id % 3 <> 2 AND CASE WHEN item_id % 4 <> 0 THEN embedding END IS NOT NULL AS stored, embedding
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)
SELECT query_id, stored, CASE WHEN stored THEN len(embedding) ELSE {WIDTH} END AS width,
  CASE WHEN stored THEN round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) ELSE 1.0 END AS length FROM q"""
)
def stored_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector that each benchmark text retrieves with; a third of them is written anew, a quarter has none stored."""
    k, text = F.col("item_id"), F.col("text")
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    said = F.when(k % 3 == 1, F.concat(F.lit(" \t"), text, F.lit("\n"))).when(k % 3 == 2, F.concat(F.lit("another "), text))
    rows = table(spark, sf_dir, "benchmark").join(stored, "item_id", "left").select(k.alias("query_id"), text.alias("question"), F.when(k % 4 != 0, F.col("embedding")).alias("embedding"), said.alias("text"))
    found = A.query_vectors(rows, lambda c: hash_embedding(c, WIDTH))
    return found.select("query_id", "stored", F.size("vector").alias("width"), F.round(norm(F.col("vector")), 6).alias("length"))
