"""Evaluation metrics as aggregations over record tables; shares are null over nothing and never rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import share


def label_counts(records: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """label, n, share: every label of the list, zero-filled; one pass, no join."""
    spark = records.sparkSession
    counts = records.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(v,) for v in labels], "label string")
    filled = names.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.withColumn("share", share(F.col("n"), F.sum("n").over(Window.partitionBy())))


def confusion(records: DataFrame, truth: str, predicted: str) -> DataFrame:
    return records.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def agreement(records: DataFrame, a: str, b: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return records.agg(F.count_if(both).alias("n_both"), F.count_if(both & (F.col(a) == F.col(b))).alias("n_equal")).withColumn(
        "share", share(F.col("n_equal"), F.col("n_both"))
    )


def score_summary(records: DataFrame, group: str, score: str) -> DataFrame:
    return records.groupBy(group).agg(F.count(score).alias("n"), F.min(score).alias("least"), F.median(score).alias("median"), F.max(score).alias("most"))


def recall_at_k(ranks: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """resolved, hits, recall: queries whose first relevant candidate ranks within k; those without truth don't count.

    ranks: query_id, item_id, rank; truth: query_id, item_id (members of the right cluster).
    """
    first = truth.join(ranks, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return first.agg(F.count("*").alias("resolved"), F.count_if(F.col("rank") <= k).alias("hits")).withColumn("recall", share(F.col("hits"), F.col("resolved")))


def percentiles(rows: DataFrame, group: str, value: str, at: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, mean, largest and count."""
    cuts = [F.expr(f"percentile_disc({q}) within group (order by {value})").alias(n) for n, q in at.items()]
    return rows.where(F.col(value).isNotNull()).groupBy(group).agg(*cuts, F.avg(value).alias("mean"), F.max(value).alias("most"), F.count("*").alias("n"))


def traceability(answers: DataFrame, group: str) -> DataFrame:
    """Over array<struct<kind, support_status, tiers array<string>>>: supported share and sources by tier."""
    seg = answers.select(group, F.explode("segments").alias("s")).where("s.kind = 'substantive'")
    tier = lambda t: F.sum(F.size(F.filter("s.tiers", lambda x: x == t)))
    out = seg.groupBy(group).agg(
        F.count("*").alias("substantive"),
        F.count_if(F.col("s.support_status") == "supported").alias("supported"),
        tier("verbatim").alias("verbatim"),
        tier("near").alias("near"),
    )
    return out.withColumn("share", share(F.col("supported"), F.col("substantive")))


def seeded_sample(rows: DataFrame, n: int, seed: str, key: str, first: Column | None = None) -> DataFrame:
    """n rows in the order of a seeded hash, those of `first` before the others: a report's spot check."""
    order = [F.desc(first)] if first is not None else []
    return rows.orderBy(*order, F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256)).limit(n)


def extraction_totals(items: DataFrame, present: int | None = None, target: float = 0.9) -> DataFrame:
    """n, verified and fidelity by item type. items: item_type, text_verified."""
    out = items.groupBy("item_type").agg(F.count("*").alias("n"), F.count_if("text_verified").alias("verified"))
    out = out.withColumn("fidelity", share(F.col("verified"), F.col("n")))
    return out.withColumn("meets_target", F.col("fidelity") >= target)


def draft_quality(ratings: DataFrame, by: str, rating: str) -> DataFrame:
    """Mean and 1-5 histogram by stratum."""
    return ratings.groupBy(by).agg(F.count(rating).alias("n"), F.avg(rating).alias("mean"), *[F.count_if(F.col(rating) == k).alias(f"n_{k}") for k in range(1, 6)])
