"""All queries of the site-audit part, and the SQL that they are compared with."""

from __future__ import annotations

from . import chain_queries, event_queries, export_queries, extract_queries, formula_queries, page_queries, projection_queries, rule_queries, run_queries, score_queries, text_queries, version_queries, walk_queries
from .page_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chain_queries", "event_queries", "export_queries", "extract_queries", "formula_queries", "page_queries", "projection_queries", "rule_queries", "run_queries", "score_queries", "text_queries", "version_queries", "walk_queries"]
