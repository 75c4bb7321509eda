"""A corpus pipeline of five operators: each stage's table is written and read as the next one's input.

Nulls: a null text is scored as an empty one, links with nothing, leaks nothing, has size 0 (the mix takes
no words from it) and, where it stays, has the end id alone; a null id is an id of its own kind, the
smallest; a null source is a source, the last. Empty texts count as null ones. Very long texts are read
as wholes by every stage. Ties: of near copies the smallest id stays, the mix chooses by a seeded hash of
the id, token files order equal ids by the text's hash. Repeated rows: of rows with equal id and text one
stays; rows with equal ids and unlike texts are documents of their own. Empty tables give empty ones; with
no labels every document has the same score, with no benchmark none leaks. Extra columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dossierspark.llm import decontaminate, mixing, ngram_join, quality, token_files
from dossierspark.llm.common import table, written

#: Near copies share five-word shingles with a Jaccard similarity of 0.8 or more.
WIDTH, NUM, DEN = 5, 80, 100


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id, by row and not by id."""
    return ngram_join.one_of_each(docs, WIDTH, NUM, DEN)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_id_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; one row for each document, read back from them."""
    return token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_id_output),
]

#: Trees, tokenizer and seeded choice are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
