"""Imports the modules that register queries."""

from tuneprep.llm import query_codes, query_decontamination, query_embeddings, query_jaccard, query_language, query_licenses, query_packing, query_quality, query_quotation, query_runs, query_secrets, query_toxicity, query_urls  # noqa: F401
from tuneprep.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
