"""Sections of pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import sections, text_blocks
from ..sources.blocks import html_blocks
from ..streaming.conformer import conform_batch
from .registry import query, table


@query()
def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of every page."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), "html")
    return sections(html_blocks(pages)).withColumn("heading_path", F.array_join("heading_path", " > "))


@query("SELECT doc_id AS document_id, 0 AS order_index, CAST(length(trim(regexp_replace(text, '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), chr(10) || ' ')) AS INTEGER) AS chars FROM documents")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files; without headings each is one section."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return sections(text_blocks(docs)).select("document_id", "order_index", F.length("text").alias("chars"))


@query()
def conformer_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations replayed as streams of model segments, one sentence each."""
    c = table(spark, sf_dir, "conversations")
    stream = c.select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("seq"),
        F.struct(
            F.col("text").alias("text"),
            (F.col("turn") / 3).cast("int").alias("paragraph"),
            F.when(F.col("role") == "system", "connective").otherwise("substantive").alias("kind"),
            F.array(F.struct(F.lit("document").alias("source_type"), F.col("turn").cast("string").alias("source_id"))).alias("sources"),
        ).alias("segment"),
    )
    return conform_batch(stream).select("run_id", "index", "paragraph", "text", "kind", F.size("sources").alias("n_sources"))
