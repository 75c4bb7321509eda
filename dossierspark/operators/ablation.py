"""One search under every combination of its switches, from one pass over the items.

The lists of a search do not depend on the switches; these say which list takes part, which of an item's two vectors
counts, and whether a judge's order is laid over the pool. So each list is made once, its rows are repeated for the
configurations that use it (eight at most), and all configurations are fused and collapsed in one plan: what identifies a query
there is the pair of configuration and query.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.vectors import best_cosine, cosine
from ..settings import DEFAULTS
from . import retrieval as R
from .components import written
from .listing import eligible

# The switches with their settings, the product's own first, and the pool that a judge orders.
SWITCHES = {"topic_list": ["on", "off"], "vector_list": ["max", "answer_only"], "llm_rerank": ["off", "on"]}
RERANK_POOL = 20


def configurations() -> list[dict]:
    """Every combination with its label, the baseline first, then by label."""
    rows = [dict(zip(SWITCHES, values)) for values in product(*SWITCHES.values())]
    labelled = [{**r, "configuration": ",".join(f"{k}={v}" for k, v in r.items())} for r in rows]
    return [labelled[0], *sorted(labelled[1:], key=lambda r: r["configuration"])]


def two_vector_list(answers: DataFrame, questions: DataFrame, most: int = DEFAULTS.per_list) -> DataFrame:
    """query_id, item_id, score, rank by the better of an item's two vectors, from the lists of either vector alone.

    An item among the best `most` by its better vector is among the best `most` of that vector's list.
    """
    both = answers.select("query_id", "item_id", "score").unionByName(questions.select("query_id", "item_id", "score"))
    best = both.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return R.ranked(best, most, F.desc("score"), F.asc("item_id"))


def _lists(items: DataFrame, queries: DataFrame, most: int) -> dict[str, DataFrame]:
    of = lambda name: items.where(F.col(name).isNotNull()).select("item_id", F.col(name).alias("vector"), "topic")
    alone = {(name, topic): written(R.vector_list(of(f"{name}_vector"), queries, most, topic=topic), "list") for name in ("answer", "question") for topic in (False, True)}
    named = {}
    for topic, name in ((False, "vector"), (True, "topic")):
        named[name, "answer_only"] = alone["answer", topic].where("score >= -1")
        named[name, "max"] = two_vector_list(named[name, "answer_only"], alone["question", topic].where("score >= -1"), most)
    return named


def ablations(items: DataFrame, queries: DataFrame, order: DataFrame, lexical: DataFrame | None = None, most: int = DEFAULTS.per_list, top: int = DEFAULTS.top_k, pool: int = RERANK_POOL) -> DataFrame:
    """configuration, query_id, item_id, fused, vector_score, rank: the best `top` of each query in each configuration.

    items: item_id, answer_vector, question_vector (null: missing), topic, cluster_id, text_verified, excluded; only
    eligible ones are ranked. queries: query_id, vector, topic. order: query_id, item_id, position of the judge.
    lexical: query_id, item_id, rank, score of eligible items, in every configuration. Items without any vector are in
    lexical lists alone and score -1; without an answer vector they are in no list of answer_only. Null and zero query
    vectors have no vector lists. Repeated positions of the judge count once, the first.
    """
    items = written(eligible(items).drop("text_verified", "excluded"), "eligible")
    lists = _lists(items, queries, most)

    def sent(ranks: DataFrame, **settings) -> DataFrame:
        """A list's rows in every configuration with these settings."""
        labels = [c["configuration"] for c in configurations() if all(c[k] == v for k, v in settings.items())]
        each = F.explode(F.array(*[F.lit(x) for x in labels])).alias("configuration")
        return ranks.select(each, "query_id", "item_id", "rank", "score").select(F.struct("configuration", "query_id").alias("query_id"), "item_id", "rank", "score")

    by_vector = lambda name, **more: sent(lists[name, "max"], vector_list="max", **more).union(sent(lists[name, "answer_only"], vector_list="answer_only", **more))
    used = {"vector": by_vector("vector"), "topic": by_vector("topic", topic_list="on")}
    if lexical is not None:
        used = {"lexical": sent(lexical.join(items.select("item_id"), "item_id", "left_semi")), **used}
    fused = R.fuse(used).drop("vector_score").withColumn("fused", F.round("fused", 9)).withColumn("asked", F.col("query_id.query_id"))
    vectors = items.select("item_id", "cluster_id", "answer_vector", "question_vector")
    asked = queries.select(F.col("query_id").alias("asked"), F.col("vector").alias("y"))
    score = F.when(F.contains(F.col("query_id.configuration"), F.lit("vector_list=max")), best_cosine(F.col("y"), F.col("answer_vector"), F.col("question_vector"))).otherwise(best_cosine(F.col("y"), F.col("answer_vector")))
    scored = fused.join(vectors, "item_id").join(asked, "asked").withColumn("vector_score", F.round(score, 9))
    kept = R.collapse(scored.select("query_id", "item_id", "cluster_id", "fused", "vector_score"), max(top, pool))
    labels = [c["configuration"] for c in configurations() if c["llm_rerank"] == "on"]
    laid = order.select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("configuration"), "query_id", "item_id", "position")
    laid = laid.select(F.struct("configuration", "query_id").alias("query_id"), "item_id", "position")
    out = R.reranked(kept, laid).where(F.col("rank") <= top)
    return out.select("query_id.configuration", "query_id.query_id", "item_id", "fused", "vector_score", "rank")


def query_vectors(questions: DataFrame, embed) -> DataFrame:
    """query_id, vector, stored: the stored vector where the text is the question's own or null, else one made now.

    questions: query_id, question, embedding (null: not stored yet), text (a rewritten turn; null: the question).
    embed: Column of texts to Column of vectors; it sees null wherever a stored vector stands. White space at the
    ends of either text does not count; a blank text has no vector.
    """
    own = strip(F.coalesce("question", F.lit("")))
    said = F.when(F.col("text").isNull(), own).otherwise(strip(F.col("text")))
    rows = questions.withColumn("_said", said).withColumn("stored", (F.col("_said") == own) & F.col("embedding").isNotNull())
    rows = rows.withColumn("_made", embed(F.when(~F.col("stored") & (F.col("_said") != ""), F.col("_said"))))
    made = F.when(F.col("_said") != "", F.col("_made"))
    return rows.select("query_id", F.when(F.col("stored"), F.col("embedding").cast("array<double>")).otherwise(made).alias("vector"), "stored")


def verbatim_candidates(kept: DataFrame, items: DataFrame, queries: DataFrame, least: float = DEFAULTS.verbatim_threshold) -> DataFrame:
    """query_id, item_id, similarity: the first candidate of a query, where it is a pair whose question is the query's.

    kept: query_id, item_id, rank. items: item_id, item_type, question_vector. queries: query_id, vector. The
    question's cosine must reach `least`; a missing vector offers nothing.
    """
    first = kept.where("rank = 1").select("query_id", "item_id")
    pairs = items.where((F.col("item_type") == "qa_pair") & F.col("question_vector").isNotNull()).select("item_id", "question_vector")
    rows = first.join(pairs, "item_id").join(queries.select("query_id", "vector"), "query_id").withColumn("similarity", cosine(F.col("vector"), F.col("question_vector")))
    return rows.where(F.col("similarity") >= least).select("query_id", "item_id", "similarity")
