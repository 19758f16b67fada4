"""Imports every query module, so that the registry is complete."""

from pagewright.plans import catalog_queries, chunk_queries, eval_queries, layout_queries, ocr_queries, qa_queries, search_queries, source_queries, stream_queries, summary_queries, text_queries  # noqa: F401
from pagewright.plans.registry import ORACLES, QUERIES  # noqa: F401
