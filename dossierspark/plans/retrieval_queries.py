"""Retrieval over documents, benchmark texts and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import hash_embedding
from ..functions.text import content_words, lexical_query, topics_for, word_share
from ..functions.vectors import cosine
from ..operators import retrieval as R
from ..operators.components import written
from ..settings import GENERIC_STOPWORDS, LEXICAL_STOPWORDS
from .registry import query, table

STOP = ", ".join(f"'{w}'" for w in LEXICAL_STOPWORDS)
ALL_STOP = ", ".join(f"'{w}'" for w in sorted({*GENERIC_STOPWORDS, *LEXICAL_STOPWORDS}))


def _items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.lit(None).cast("string").alias("question"), F.col("text").alias("answer"))


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("topic"))


def _vector_queries(spark, sf):
    """The stated query set of a search: every id divisible by 50."""
    return _vectors(spark, sf).where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")


TERMS = f"""
qterm AS (
  SELECT DISTINCT item_id AS query_id, t AS term
  FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^0-9a-z]+')) AS t FROM benchmark)
  WHERE t <> '' AND t <> 'or' AND t NOT IN ({STOP})
), dterm AS (
  SELECT doc_id, t AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^0-9a-z]+')) AS t FROM documents) WHERE t <> ''
), counted AS (SELECT doc_id, term, count(*) * 4 AS w FROM dterm GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS positions FROM dterm GROUP BY doc_id),
scored AS (
  SELECT query_id, doc_id AS item_id, count(*) AS n_terms, sum(w) / 10.0 / ln(any_value(positions) + 1.0) AS score
  FROM counted JOIN qterm USING (term) JOIN size USING (doc_id) GROUP BY ALL
), lexical AS (
  SELECT query_id, item_id, n_terms, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM scored QUALIFY rank <= 20
)"""


@query(
    f"""SELECT item_id, array_to_string(list_filter(list_transform(d, lambda i: i[1]), lambda x: x <> ''), ' or ') AS terms FROM (
  SELECT item_id, list_sort(list(DISTINCT [t, lpad(CAST(p AS VARCHAR), 6, '0')])) AS unused,
    list([t, lpad(CAST(p AS VARCHAR), 6, '0')] ORDER BY p) AS d
  FROM (SELECT item_id, t, min(p) AS p FROM (
    SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^0-9a-z]+') AS w FROM benchmark))
    WHERE t <> '' AND t NOT IN ({STOP}) GROUP BY ALL)
  GROUP BY item_id)"""
)
def lexical_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical query of every benchmark text."""
    return table(spark, sf_dir, "benchmark").select("item_id", lexical_query(F.col("text")).alias("terms"))


@query(f"WITH {TERMS} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM lexical")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 without stemming: the best 20 documents of every benchmark text."""
    return R.lexical_list(_items(spark, sf_dir), _queries(spark, sf_dir), stem=False).select("query_id", "item_id", "rank")


@query()
def lexical_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 documents of every benchmark text by English stems, stop words left out."""
    return R.lexical_list(_items(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "item_id", "score", "rank")


VECTOR = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
pair AS (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label = i.label AS same, round(list_cosine_similarity(q.e, i.e), 9) AS score
  FROM v q JOIN v i ON q.vec_id % 50 = 0
), vec AS (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pair QUALIFY rank <= 20
), top AS (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pair WHERE same QUALIFY rank <= 20
)"""


@query(f"WITH {VECTOR} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest 20 of every 50th vector."""
    return R.vector_list(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir)).select("query_id", "item_id", "rank")


@query(f"WITH {VECTOR} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM top")
def topic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the query's topic."""
    return R.vector_list(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), topic=True).select("query_id", "item_id", "rank")


def _fused(spark, sf, topic_list=True):
    items, queries = _vectors(spark, sf), _vector_queries(spark, sf)
    lists = {"vector": R.vector_list(items, queries)}
    if topic_list:
        lists["topic"] = R.vector_list(items, queries, topic=True)
    return R.fuse(lists)


FUSED = """
ids AS (SELECT query_id, item_id, score FROM vec UNION SELECT query_id, item_id, score FROM top),
fused AS (
  SELECT ids.query_id, ids.item_id, ids.score AS vector_score, vec.rank AS vector_rank, top.rank AS topic_rank,
    coalesce(1.0 / (vec.rank + 60), 0.0)::DOUBLE + coalesce(1.0 / (top.rank + 60), 0.0)::DOUBLE AS fused
  FROM ids LEFT JOIN vec USING (query_id, item_id) LEFT JOIN top USING (query_id, item_id)
)"""


@query(f"WITH {VECTOR}, {FUSED} SELECT query_id, item_id, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(topic_rank AS INTEGER) AS topic_rank, round(fused, 9) AS fused FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists fused."""
    return _fused(spark, sf_dir).select("query_id", "item_id", "vector_rank", "topic_rank", F.round("fused", 9).alias("fused"))


COLLAPSED = """
clustered AS (SELECT f.*, v.label AS cluster_id FROM fused f JOIN v ON v.vec_id = f.item_id),
one AS (SELECT * FROM clustered QUALIFY row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY round(fused, 9) DESC, vector_score DESC, item_id) = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, vector_score DESC, item_id) AS rank FROM one QUALIFY rank <= 8)"""


def _kept(spark, sf, **toggles):
    clusters = _vectors(spark, sf).select("item_id", F.col("topic").alias("cluster_id"))
    return R.collapse(_fused(spark, sf, **toggles).withColumn("fused", F.round("fused", 9)).join(clusters, "item_id"))


@query(f"WITH {VECTOR}, {FUSED}, {COLLAPSED} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM kept")
def cluster_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item of each cluster, best eight."""
    return _kept(spark, sf_dir).select("query_id", "item_id", "rank")


@query(
    f"""WITH {VECTOR}, {FUSED}, {COLLAPSED}, alone AS (
  SELECT query_id, item_id, score AS vector_score, 1.0 / (rank + 60) AS fused, label AS cluster_id FROM vec JOIN v ON vec_id = item_id
), one2 AS (SELECT * FROM alone QUALIFY row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY round(fused::DOUBLE, 9) DESC, vector_score DESC, item_id) = 1),
kept2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused::DOUBLE, 9) DESC, vector_score DESC, item_id) AS rank FROM one2 QUALIFY rank <= 8)
SELECT 'both' AS configuration, query_id, item_id, CAST(rank AS INTEGER) AS rank FROM kept
UNION ALL SELECT 'vector_only', query_id, item_id, CAST(rank AS INTEGER) FROM kept2"""
)
def rank_ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists switched by parameters."""
    both, alone = _kept(spark, sf_dir), _kept(spark, sf_dir, topic_list=False)
    shape = lambda d, n: d.select(F.lit(n).alias("configuration"), "query_id", "item_id", "rank")
    return shape(both, "both").union(shape(alone, "vector_only"))


@query(
    f"""WITH {TERMS}, covering AS (
  SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY n_terms DESC, item_id) AS rank FROM scored QUALIFY rank <= 20
), ids AS (SELECT query_id, item_id FROM lexical UNION SELECT query_id, item_id FROM covering),
cluster AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS cluster_id FROM documents),
fused AS (
  SELECT ids.query_id, ids.item_id, cluster_id, scored.score,
    round((coalesce(1.0 / (l.rank + 60), 0.0)::DOUBLE + coalesce(1.0 / (c.rank + 60), 0.0)::DOUBLE), 9) AS fused
  FROM ids LEFT JOIN lexical l USING (query_id, item_id) LEFT JOIN covering c USING (query_id, item_id)
  JOIN scored USING (query_id, item_id) JOIN cluster ON cluster.doc_id = ids.item_id
), one AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY fused DESC, score DESC, item_id) = 1)
SELECT query_id, item_id, cluster_id, fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, score DESC, item_id) AS INTEGER) AS rank
FROM one QUALIFY rank <= 8"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of R12 that SQL can check (see hybrid_retrieval): lexical rank and term coverage over all documents, fused, copies collapsed, best eight."""
    scored = written(R.lexical_scores(_items(spark, sf_dir), _queries(spark, sf_dir), stem=False, most=20, by=("score", "n_terms")), "scored")
    lexical = R.ranked(scored, 20, F.desc("score"), F.asc("item_id"))
    covering = R.ranked(scored, 20, F.desc("n_terms"), F.asc("item_id"))
    normal = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "))
    copies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.sha2(normal.cast("binary"), 256).alias("sha"))
    copies = written(copies, "copies")
    fused = written(R.fuse({"lexical": lexical, "covering": covering}).withColumn("fused", F.round("fused", 9)), "fused")
    # copies of the candidates alone
    own = written(copies.join(fused.select("item_id").distinct(), "item_id", "left_semi"), "own")
    least = copies.join(own.select("sha").distinct(), "sha", "left_semi").groupBy("sha").agg(F.min("item_id").alias("cluster_id"))
    full = fused.join(own.join(least, "sha").select("item_id", "cluster_id"), "item_id")
    return R.collapse(full).select("query_id", "item_id", "cluster_id", "fused", "rank")


CONTENT = lambda c: f"""list_distinct(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'),
  lambda w: (length(w) >= 3 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN ({ALL_STOP})),
  lambda w: CASE WHEN regexp_full_match(w, '..+[^s]s') THEN w[:-2] ELSE w END))"""  # noqa: E731


@query(
    f"""WITH {TERMS}, judged AS (
  SELECT query_id, max(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, d)) / len(q) END) AS share FROM (
    SELECT query_id, {CONTENT('b.text')} AS q, {CONTENT('d.text')} AS d
    FROM lexical l JOIN benchmark b ON b.item_id = l.query_id JOIN documents d ON d.doc_id = l.item_id WHERE rank <= 3)
  GROUP BY query_id
)
SELECT b.item_id AS query_id, CASE WHEN coalesce(share, 0) >= 0.5 THEN 'covered' WHEN coalesce(share, 0) >= 0.2 THEN 'partial' ELSE 'new' END AS coverage,
  'judge' AS label_source FROM benchmark b LEFT JOIN judged ON judged.query_id = b.item_id"""
)
def coverage_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a question's content words in the best three lexical candidates, without the floor (see coverage_triage)."""
    queries = _queries(spark, sf_dir)
    top = written(R.lexical_list(_items(spark, sf_dir), queries, most=3, stem=False).select("query_id", "item_id"), "top")
    # content words of the candidates alone
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").join(top.select("item_id").distinct(), "item_id")
    pairs = top.join(queries.select("query_id", content_words(F.col("text")).alias("q")), "query_id").join(docs.select("item_id", content_words(F.col("text")).alias("d")), "item_id")
    judged = pairs.groupBy("query_id").agg(F.max(word_share(F.col("q"), F.col("d"))).alias("share"))
    return R.triage(queries.select("query_id", F.lit(1.0).alias("best")), judged)


#: Places of the hash embeddings that stand for those of a model.
WIDTH = 64


def _retrieved(spark, sf, stem=True):
    """The fused and collapsed candidates of every benchmark text from its lexical, vector and topic lists."""
    from .text_queries import KEYS

    embedded = lambda d: d.withColumn("vector", hash_embedding("text", WIDTH)).withColumn("topics", topics_for(F.coalesce("text", F.lit("")), list(KEYS), KEYS))
    normal = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " ")).cast("binary"), 256)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", normal.alias("sha")).where("text is not null")
    docs = written(embedded(docs).drop("text"), "embedded")
    queries = written(embedded(_queries(spark, sf)), "queries")
    lists = R.retrieval_lists(_items(spark, sf), docs, queries, stem)
    copies = docs.groupBy("sha").agg(F.min("item_id").alias("cluster_id"))
    clusters = docs.join(copies, "sha").select("item_id", "cluster_id")
    fused = R.fuse(lists).drop("vector_score").withColumn("fused", F.round("fused", 9))
    # every candidate has its vector score, whichever list it comes from
    scored = (
        fused.join(docs.select("item_id", F.col("vector").alias("x")), "item_id")
        .join(F.broadcast(queries.select("query_id", F.col("vector").alias("y"))), "query_id")
        .withColumn("vector_score", F.round(cosine(F.col("x"), F.col("y")), 9))
        .drop("x", "y")
    )
    return R.collapse(scored.join(clusters, "item_id"))


@query()
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical, vector and topic lists of every benchmark text over all documents, fused, copies collapsed, best eight."""
    return _retrieved(spark, sf_dir).select("query_id", "item_id", "cluster_id", "lexical_rank", "vector_rank", "topic_rank", "fused", "vector_score", "rank")


@query()
def coverage_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New below the floor of the best vector score, else judged by the best three of the fused candidates."""
    queries, kept = _queries(spark, sf_dir), written(_retrieved(spark, sf_dir), "kept")
    top = kept.where("rank <= 3").select("query_id", "item_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text").join(top.select("item_id").distinct(), "item_id")
    pairs = top.join(docs, "item_id").join(queries.select("query_id", content_words(F.col("text")).alias("q")), "query_id")
    judged = pairs.groupBy("query_id").agg(F.max(word_share(F.col("q"), content_words(F.col("text")))).alias("share"))
    return R.triage(R.best_vector_score(kept, queries), judged)


@query(
    f"""WITH {VECTOR}, truth AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id FROM v q JOIN v i ON q.label = i.label AND q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id),
ranks AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM vec WHERE query_id <> item_id),
first AS (SELECT query_id, min(rank) AS rank FROM truth LEFT JOIN ranks USING (query_id, item_id) GROUP BY query_id)
SELECT count(*) AS resolved, count(*) FILTER (rank <= 8) AS hits, count(*) FILTER (rank <= 8) / count(*) AS recall FROM first"""
)
def recall_at_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate of the query's own label among the first eight."""
    from ..operators.metrics import recall_at_k

    found = R.vector_list(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir)).where("query_id <> item_id")
    ranks = R.ranked(found.drop("rank"), 20, F.desc("score"), F.asc("item_id"))
    truth = (
        _vector_queries(spark, sf_dir).select("query_id", "topic").join(_vectors(spark, sf_dir).select("item_id", "topic"), "topic").where("query_id <> item_id").select("query_id", "item_id")
    )
    return recall_at_k(ranks, truth, 8)
