"""All queries of the library by name, with SQL where SQL can say it."""

from . import ablation_queries, answer_queries, correction_queries, drafting_queries, extraction_queries, history_queries, lineage_queries, listing_queries, metrics_queries, retrieval_queries, review_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
